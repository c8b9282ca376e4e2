"""Late rows kept beside the others instead of being dropped.

Every micro-batch is split by the watermark it runs under: the largest event time of all earlier batches less the allowed
lateness. Rows and marks are written under the batch id, so a retried batch replaces its own folder and sees the same watermark,
and counts outlive the driver: they are counts over stored rows. A batch's mark is written last; readers leave batches without one alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

_MARK = "largest timestamp, rows long"


def _last_mark(spark: SparkSession, target: str, before: int | None = None) -> Row | None:
    """The mark of the newest finished batch (with a smaller id than ``before``): folders are listed, one is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/marks")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in (fs.listStatus(path) if fs.exists(path) else []) if s.getPath().getName().startswith("batch=")]
    # The marker file is there only if the write has ended.
    done = [int(p.getName()[6:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    done = [n for n in done if before is None or n < before]
    if not done:
        return None
    return spark.read.schema(_MARK).parquet(f"{target}/marks/batch={max(done)}").select("*", F.lit(max(done)).alias("batch")).first()


def start(events: DataFrame, target: str, checkpoint: str, lateness: str = "1 hour", time: str = "event_time", every: str | None = None) -> StreamingQuery:
    """Splits the stream into ``target``; runs until stopped with ``every``, else over what is there now. Rows without a time are never late."""

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _last_mark(spark, target, batch_id)
        largest = F.lit(before["largest"] if before else None).cast("timestamp")
        watermark = largest - F.expr(f"INTERVAL {lateness}")
        seen = Observation()
        rows = batch.withColumns({"watermark": watermark, "is_late": F.coalesce(F.col(time) < watermark, F.lit(False))})
        rows = rows.observe(seen, F.max(F.col(time).cast("timestamp")).alias("largest"), F.count("*").alias("rows"))
        rows.write.mode("overwrite").partitionBy("is_late").parquet(f"{target}/rows/batch={batch_id}")
        mark = spark.createDataFrame([(seen.get["largest"], seen.get["rows"])], _MARK)
        mark.select(F.greatest("largest", largest).alias("largest"), "rows").coalesce(1).write.mode("overwrite").parquet(f"{target}/marks/batch={batch_id}")

    writer = events.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rows(spark: SparkSession, target: str, kind: T.StructType) -> DataFrame:
    """All rows of finished batches (``kind`` is the schema of the events) with watermark, batch and is_late."""
    stored = T.StructType([*kind.fields, T.StructField("watermark", T.TimestampType()), T.StructField("batch", T.LongType()), T.StructField("is_late", T.BooleanType())])
    last = _last_mark(spark, target)
    if last is None:
        return spark.createDataFrame([], stored)
    return spark.read.schema(stored).parquet(f"{target}/rows").where(F.col("batch") <= last["batch"])


def kept(spark: SparkSession, target: str, kind: T.StructType) -> DataFrame:
    return rows(spark, target, kind).where("NOT is_late").select(*kind.names)


def late(spark: SparkSession, target: str, kind: T.StructType) -> DataFrame:
    """Late rows with the batch they came in and the watermark it ran under."""
    return rows(spark, target, kind).where("is_late").drop("is_late")


def counts(spark: SparkSession, target: str, kind: T.StructType) -> DataFrame:
    """Kept and late rows per batch, over all runs of the stream."""
    return rows(spark, target, kind).groupBy("batch").agg(F.count_if(~F.col("is_late")).alias("n_kept"), F.count_if("is_late").alias("n_late"))

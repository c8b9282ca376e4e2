"""Run state kept up to date from the event stream.

Each micro-batch is folded by itself into the maxima and minima of the batch fold and written under its batch id; a
retried batch replaces its own folder. Combining partials does not depend on order or repetition, so the result
equals the batch result however late an event comes: no state is kept in memory, no watermark is needed and nothing is
dropped. A backfill of any age is an event like any other. ``compact`` keeps the number of folders small and may run
while the stream does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from flowtables.operators import events as E


def start(events: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs until stopped with ``every``, else over what is there now."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        E.partials(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _stored(spark: SparkSession, target: str) -> DataFrame:
    return E.combine_partials(spark.read.parquet(target).drop("batch"))


def current(spark: SparkSession, target: str) -> DataFrame:
    """State of every run as of the last finished micro-batch."""
    return E.run_states(_stored(spark, target))


def _folders(spark: SparkSession, target: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(fs, s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]


def compact(spark: SparkSession, target: str) -> None:
    """The partials so far as one folder, in place; the stream and its readers go on meanwhile.

    The folders seen at the start are deleted after the combined one is there. Between the two a reader meets
    the same partials twice, which changes nothing; batches written meanwhile stay as they are.
    """
    before = _folders(spark, target)
    combined = E.combine_partials(spark.read.option("basePath", target).parquet(*[p.toString() for _, p in before]).drop("batch"))
    combined.write.parquet(f"{target}/batch=-{uuid.uuid4().int >> 66}")
    for fs, path in before:
        fs.delete(path, True)


def start_operator_runs(events: DataFrame, store: str, target: str, checkpoint: str) -> StreamingQuery:
    """Attempts of each operator: events are stored by schedule date, and only runs with new events are folded again.

    The dates of a batch (few, whatever its rows) prune the folders of the history that are read.
    """
    spark = events.sparkSession
    kinds = events.schema

    def fold(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("scheduled_on", batch["scheduled_at"].cast("date")).persist()
        dated.write.mode("overwrite").partitionBy("scheduled_on").parquet(f"{store}/batch={batch_id}")
        touched = dated.select(*E.RUN).distinct()
        days = [r[0] for r in dated.select(F.col("scheduled_on").cast("string")).distinct().collect()]
        on = F.col("scheduled_on").isin(*[F.lit(d).cast("date") for d in days if d]) if any(days) else F.lit(False)
        history = spark.read.schema(kinds.add("scheduled_on", "date").add("batch", "long")).parquet(store).where(f"batch <= {batch_id}")
        again = history.where(on | F.col("scheduled_on").isNull() if None in days else on)
        again = again.join(touched, E.RUN, "left_semi").select(*kinds.fieldNames()[: len(batch.columns)])
        E.operator_runs(again).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        dated.unpersist()

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_operator_runs(spark: SparkSession, target: str) -> DataFrame:
    """The newest fold of each run."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy(*E.RUN).agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch")
    return rows.join(newest, [*E.RUN, "batch"], "left_semi").drop("batch")

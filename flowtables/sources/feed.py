"""Change events as messages: value only, no key, to any streaming or batch format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables import session
from flowtables.plans import incremental


def envelope(event_id: Column, occurred_at: Column, project: Column, event_type: Column, payload: Column) -> Column:
    """The message text of one change."""
    return F.to_json(
        F.struct(
            event_id.alias("event_id"),
            occurred_at.alias("occurred_at"),
            project.alias("project"),
            event_type.alias("event_type"),
            payload.alias("payload"),
        ),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"},
    )


def write(messages: DataFrame, target: str, fmt: str = "parquet", **options: str) -> None:
    """Batch write of the ``value`` column; ``fmt`` is ``kafka`` where its connector is installed."""
    writer = messages.select("value").write.format(fmt).mode("append").options(**options)
    writer.save() if fmt == "kafka" else writer.save(target)


def write_stream(messages: DataFrame, target: str, checkpoint: str, every: str = "10 seconds", available_now: bool = False, fmt: str = "parquet", **options: str):
    """Micro-batches of a stream, at least once: a batch that failed is written again under the same id.

    Each batch has its own folder, replaced when the batch is retried, so readers see every message once. Formats that
    are not files (``kafka`` needs its connector) get ``options`` and an append per batch: at least once.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        writer = batch.select("value").write.format(fmt).options(**options)
        if fmt in ("parquet", "orc", "json", "text", "csv"):
            writer.mode("overwrite").save(f"{target}/batch={batch_id}")
        else:
            writer.mode("append").save()

    writer = messages.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def export_window(spark: SparkSession, df: DataFrame, ts: str, scheduled_at: str, columns: list[str], **window) -> DataFrame:
    """Sends the rows of one run's data window as messages and returns what was sent."""
    start, end = incremental.bounds_of_run(spark, scheduled_at, **window)
    rows = incremental.read_window(df, ts, start, end)
    messages = rows.select(columns[0], F.to_json(F.struct(*columns)).alias("value"))
    target = session.scratch(spark, "export")
    messages.write.mode("append").parquet(target)
    return spark.read.schema(messages.schema).parquet(target)

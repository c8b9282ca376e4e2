"""Raw event payloads to typed events, the same for batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowtables.functions import names as N

PAYLOAD = (
    "status STRING, event_time DOUBLE, task_id STRING, scheduled_at STRING, monitoring MAP<STRING, STRING>, "
    "slas ARRAY<STRUCT<dag_id: STRING, scheduled_at: STRING>>"
)
_TIME = "\"yyyy-MM-dd'T'HH:mm:ss'Z'\""


def parse(df: DataFrame, event_type: str, payload: str) -> DataFrame:
    """Adds type, status, event_time, operator_name, scheduled_at, slas, monitoring and error.

    A row with an error is kept: callers route it aside. SLA events need a list of breaches; all
    others need a known status, a time, an operator and a schedule time.
    """
    step = df.selectExpr("*", f"{N.event_type(event_type)} AS type", f"from_json({payload}, '{PAYLOAD}') AS p")
    step = step.selectExpr("*", f"try_to_timestamp(p.scheduled_at, {_TIME}) AS __at", f"{N.run_state('p.status')} AS __status")
    slas = f"transform(p.slas, s -> named_struct('job', s.dag_id, 'scheduled_at', try_to_timestamp(s.scheduled_at, {_TIME})))"
    error = """CASE
        WHEN type IS NULL THEN 'unknown event type'
        WHEN type = 'sla_miss' THEN CASE
            WHEN coalesce(size(p.slas), 0) = 0 THEN 'sla list is empty'
            WHEN exists(p.slas, s -> coalesce(s.dag_id, '') = '') THEN 'sla without a job'
            WHEN exists(__slas, s -> s.scheduled_at IS NULL) THEN 'sla with an unreadable scheduled_at' END
        WHEN __status IS NULL THEN 'unknown status'
        WHEN coalesce(p.event_time, 0) = 0 THEN 'event_time is missing'
        WHEN coalesce(p.task_id, '') = '' THEN 'task_id is missing'
        WHEN coalesce(p.scheduled_at, '') = '' THEN 'scheduled_at is missing'
        WHEN __at IS NULL THEN 'scheduled_at is not readable' END"""
    return step.selectExpr("*", f"{slas} AS __slas").selectExpr(
        *df.columns,
        "type",
        "__status AS status",
        "timestamp_seconds(CAST(p.event_time AS BIGINT)) AS event_time",
        "p.task_id AS operator_name",
        "__at AS scheduled_at",
        "__slas AS slas",
        "p.monitoring AS monitoring",
        f"{error} AS error",
    )

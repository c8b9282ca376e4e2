"""Registry, run and event views derived from the given tables.

The same text runs on Spark (tables passed as DataFrames) and, pasted as common table
expressions, in the SQL checks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # job registry
    "jobs_v": """
SELECT p_partkey AS job_id, concat('job_', p_partkey) AS name,
       concat('proj_', p_partkey % 3) AS project, concat('ns_', p_size % 4) AS namespace,
       concat('store://wh:d', p_partkey % 3, '.t', p_partkey) AS destination,
       p_partkey % 50 = 0 AS is_deleted,
       CASE p_partkey % 4 WHEN 0 THEN '0 2 * * *' WHEN 1 THEN '@daily'
            WHEN 2 THEN '0 */6 * * *' ELSE '0 2 2,11,19,26 * *' END AS cron,
       CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 2 END AS w_version,
       CASE p_partkey % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'h' WHEN 2 THEN 'w' ELSE 'M' END AS w_truncate,
       CASE p_partkey % 5 WHEN 0 THEN '-24h' WHEN 1 THEN '' WHEN 2 THEN '1M' WHEN 3 THEN '-1M24h' ELSE '0' END AS w_offset,
       CASE p_partkey % 7 WHEN 0 THEN '24h' WHEN 1 THEN '48h' WHEN 2 THEN '1M24h' WHEN 3 THEN '2M' WHEN 4 THEN '168h' WHEN 5 THEN '' ELSE '1M' END AS w_size,
       CASE WHEN p_partkey % 2 = 0 THEN 7200 ELSE 0 END AS sla_seconds,
       CAST(DATE '1995-01-01' + CAST(p_partkey % 30 AS INT) AS TIMESTAMP) AS start_at,
       CASE WHEN p_partkey % 9 = 0 THEN CAST(DATE '1995-03-01' + CAST(p_partkey % 20 AS INT) AS TIMESTAMP) END AS end_at
FROM {part}""",
    # tables each job reads
    "job_sources_v": """
SELECT j.job_id, k.destination AS source
  FROM jobs_v j JOIN jobs_v k ON k.job_id = CAST(FLOOR(j.job_id / 2.0) AS BIGINT) WHERE j.job_id > 1
UNION ALL
SELECT j.job_id, k.destination
  FROM jobs_v j JOIN jobs_v k ON k.job_id = CAST(FLOOR(j.job_id / 3.0) AS BIGINT) WHERE j.job_id % 5 = 0 AND j.job_id > 2
UNION ALL
SELECT job_id, concat('store://ext:unknown.t', job_id) FROM jobs_v WHERE job_id % 7 = 0""",
    # declared upstream names
    "job_static_v": """
SELECT j.job_id, CASE WHEN j.job_id % 8 = 0 THEN concat(k.project, '/', k.name) ELSE k.name END AS static_upstream
  FROM jobs_v j JOIN jobs_v k ON k.job_id = CAST(FLOOR(j.job_id / 4.0) AS BIGINT) WHERE j.job_id % 4 = 0 AND j.job_id > 3
UNION ALL
SELECT job_id, concat('missing_', job_id) FROM jobs_v WHERE job_id % 31 = 0""",
    # actual runs, at the hour the job's schedule uses
    "runs_v": """
SELECT o_orderkey AS run_id, o_custkey % 200 AS job_id,
       CAST(o_orderdate + CASE WHEN o_custkey % 4 IN (0, 3) THEN INTERVAL '2' HOUR ELSE INTERVAL '0' HOUR END AS TIMESTAMP) AS scheduled_at,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS state,
       CAST(o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL '3' HOUR ELSE INTERVAL '5' HOUR END AS TIMESTAMP) AS start_time,
       CASE WHEN o_orderstatus = 'O' THEN CAST(TIMESTAMP '3000-01-01 00:00:00' AS TIMESTAMP)
            ELSE CAST(o_orderdate + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL '6' HOUR ELSE INTERVAL '9' HOUR END AS TIMESTAMP) END AS end_time,
       CASE WHEN o_custkey % 2 = 0 THEN 7200 ELSE 0 END AS sla_seconds
FROM {orders}""",
    # run event stream
    "run_events_v": """
SELECT event_id, concat('proj_', user_id % 3) AS project, concat('ns_', user_id % 4) AS namespace, user_id AS job_id,
       CAST(ts AS TIMESTAMP) AS event_time, CAST(date_trunc('day', ts) AS TIMESTAMP) AS scheduled_at,
       CASE event_type WHEN 'signup' THEN 'sensor_start' WHEN 'view' THEN 'task_start'
            WHEN 'click' THEN 'task_success' WHEN 'purchase' THEN 'job_success' ELSE 'failure' END AS type,
       CASE event_type WHEN 'signup' THEN 'wait' WHEN 'view' THEN 'bq' WHEN 'click' THEN 'bq' ELSE '' END AS operator_name,
       value
FROM {events}""",
    # each run at an uneven time of day, with its job's window settings
    "timed_runs_v": """
SELECT r.run_id, r.job_id, r.scheduled_at + (r.run_id % 50000) * INTERVAL '1' SECOND AS at_time, r.scheduled_at, r.state,
       j.w_version, j.w_truncate, j.w_offset, j.w_size, j.cron
FROM runs_v r JOIN jobs_v j ON j.job_id = r.job_id""",
    # duration texts, valid and not
    "duration_texts_v": """
SELECT p_partkey AS job_id,
       CASE p_partkey % 7 WHEN 0 THEN concat(p_size, 'h', p_partkey % 60, 'm') WHEN 1 THEN concat('-', p_size, 'M', p_partkey % 24, 'h')
            WHEN 2 THEN concat(p_size, 'M') WHEN 3 THEN concat('+', p_size, 'm30s') WHEN 4 THEN concat(p_size, 'd')
            WHEN 5 THEN concat(p_size, '') ELSE concat(p_size, 'M', p_partkey % 24, 'h', p_size, 'm') END AS duration
FROM {part}""",
    # replay requests
    "replays_v": """
SELECT c_custkey AS replay_id, c_custkey % 200 AS job_id, concat('proj_', (c_custkey % 200) % 3) AS project,
       CAST(DATE '1995-01-01' + CAST(c_custkey % 60 AS INT) AS TIMESTAMP) AS start_time,
       CAST(DATE '1995-01-01' + CAST(c_custkey % 60 + c_custkey % 10 AS INT) AS TIMESTAMP) AS end_time,
       CASE c_nationkey % 7 WHEN 0 THEN 'created' WHEN 1 THEN 'in progress' WHEN 2 THEN 'partial replayed'
            WHEN 3 THEN 'replayed' WHEN 4 THEN 'success' WHEN 5 THEN 'failed' ELSE 'invalid' END AS status,
       c_custkey % 2 = 0 AS parallel,
       CAST(DATE '1995-04-01' + CAST(c_custkey % 90 AS INT) AS TIMESTAMP) AS created_at,
       CAST(DATE '1995-04-02' + CAST(c_custkey % 97 AS INT) AS TIMESTAMP) AS updated_at,
       c_mktsegment AS segment
FROM {customer}""",
    # alert settings
    "job_alerts_v": """
SELECT job_id, 'sla_miss' AS alert_on, concat('slack://#c', job_id % 5) AS channel FROM jobs_v WHERE job_id % 2 = 0
UNION ALL
SELECT job_id, 'failure', 'pagerduty://#svc' FROM jobs_v WHERE job_id % 3 = 0""",
    # stored edges: each job with the producer of a table it reads
    "edges_v": """
SELECT DISTINCT k.job_id AS src, s.job_id AS dst
FROM job_sources_v s JOIN jobs_v k ON k.destination = s.source""",
}


def _needs(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def _ordered(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _ordered(_needs(VIEWS[name]), seen)
            if name not in seen:
                seen.append(name)
    return seen


def ctes(*names: str, **tables: str) -> str:
    """``WITH`` list (without the keyword) of the views and all they need."""
    body = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _ordered(list(names), []))
    return body.format(**tables) if tables else body


def oracle_text(sql: str) -> str:
    """Puts the views a check refers to in front of it."""
    needed = _needs(sql)
    if not needed:
        return sql.strip()
    head = ctes(*needed, **{t: t for t in TABLES})
    sql = sql.strip()
    for word in ("WITH RECURSIVE", "WITH"):
        if sql.startswith(word + " ") or sql.startswith(word + "\n"):
            return f"{word} {head},\n{sql[len(word):]}"
    return f"WITH {head}\n{sql}"


class Tables:
    """The given parquet tables and the derived views as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        needed = _needs(text)
        full = f"WITH {ctes(*needed)}\n{text}" if needed else text
        used = [t for t in TABLES if "{" + t + "}" in full]
        return self.spark.sql(full, **{t: getattr(self, t) for t in used})

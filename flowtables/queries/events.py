"""Event folds, counters, alerts, change feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.operators import alerts as A
from flowtables.operators import events as E
from flowtables.operators import skew
from flowtables.queries.registry import query
from flowtables.queries.runs import with_alerts
from flowtables.sources import feed

_RUN = "project, job_id, scheduled_at"
_TYPED = """typed AS (SELECT *, CASE WHEN type LIKE 'task%' THEN 'task' WHEN type LIKE 'sensor%' THEN 'sensor' ELSE 'job' END AS op,
  CASE WHEN type LIKE '%success' THEN 'success' ELSE 'failed' END AS ended_as FROM run_events_v),
firsts AS (SELECT *, row_number() OVER (PARTITION BY project, job_id, scheduled_at, op, operator_name ORDER BY event_time, event_id) = 1 AS is_first FROM typed),
steps AS (SELECT *, CASE WHEN op = 'job' THEN ended_as WHEN op = 'sensor' THEN 'wait_upstream' ELSE 'in_progress' END AS state FROM firsts WHERE op = 'job' OR type LIKE '%start' OR is_first)"""


# Hooks, retries, and SLA events that list runs: every 37th event's run, and one that never ran.
_RETYPED = "CASE WHEN event_id % 13 = 0 THEN replace(type, 'task_', 'hook_') WHEN event_id % 29 = 0 AND type = 'task_success' THEN 'task_retry' ELSE type END AS type"
_RETYPED_SQL = (
    f"raw AS (SELECT * REPLACE ({_RETYPED}) FROM run_events_v), missed AS (SELECT DISTINCT {_RUN} FROM run_events_v WHERE event_id % 37 = 0), "
    + _TYPED.replace("FROM run_events_v)", "FROM raw)").replace("WHEN type LIKE 'sensor%'", "WHEN type LIKE 'hook%' THEN 'hook' WHEN type LIKE 'sensor%'")
)


@query(
    "run_state_fold",
    f"""WITH {_RETYPED_SQL}, s AS (SELECT {_RUN}, arg_max(state, event_id) AS state, max(CASE WHEN op = 'job' THEN event_time END) AS end_time FROM steps GROUP BY ALL)
SELECT {_RUN}, s.state, f.start_time, s.end_time, {_RUN.replace("project", "(project").replace("scheduled_at", "scheduled_at)")} IN (SELECT (project, job_id, scheduled_at) FROM missed) AS sla_alert
FROM (SELECT {_RUN}, min(event_time) AS start_time FROM typed GROUP BY ALL) f JOIN s USING ({_RUN})""",
)
def run_state_fold(t):
    events = t.run_events_v
    listed = "array(named_struct('job_id', job_id, 'scheduled_at', scheduled_at), named_struct('job_id', -job_id - 1, 'scheduled_at', scheduled_at))"
    kind = "array<struct<job_id: bigint, scheduled_at: timestamp>>"
    sla = events.where("event_id % 37 = 0").withColumns(
        {"slas": F.expr(f"CAST({listed} AS {kind})"), "type": F.lit("sla_miss"), "scheduled_at": F.lit(None).cast(events.schema["scheduled_at"].dataType), "operator_name": F.lit(None).cast("string")}
    )
    own = events.withColumns({"type": F.expr(_RETYPED.removesuffix(" AS type")), "slas": F.expr(f"CAST(NULL AS {kind})")})
    return E.fold_runs(own.unionByName(sla)).drop("monitoring")


_ATTEMPTS = f"""{_TYPED}, n AS (SELECT *, CAST(sum(CASE WHEN type LIKE '%start' THEN 1 ELSE 0 END) OVER (PARTITION BY project, job_id, scheduled_at, op, operator_name ORDER BY event_time, event_id) AS BIGINT) AS attempt FROM typed WHERE op <> 'job'),
attempts AS (SELECT {_RUN}, op AS operator_type, operator_name, attempt, min(event_time) AS start_time, max(CASE WHEN type NOT LIKE '%start' THEN event_time END) AS end_time,
  CASE WHEN count(CASE WHEN type NOT LIKE '%start' THEN 1 END) > 0 THEN 'success' ELSE 'running' END AS status FROM n GROUP BY ALL)"""


@query("operator_run_fold", f"WITH {_ATTEMPTS} SELECT * FROM attempts")
def operator_run_fold(t):
    return E.operator_runs(t.run_events_v)


@query(
    "latest_operator_run",
    f"""WITH {_ATTEMPTS} SELECT {_RUN}, operator_type, operator_name, start_time, end_time, status, starts FROM (
  SELECT *, max(attempt) OVER p AS starts, row_number() OVER (PARTITION BY {_RUN}, operator_type, operator_name ORDER BY attempt DESC) AS rn FROM attempts WINDOW p AS (PARTITION BY {_RUN}, operator_type, operator_name)) WHERE rn = 1""",
)
def latest_operator_run(t):
    return E.latest_operator_runs(E.operator_runs(t.run_events_v))


@query(
    "operator_durations",
    f"""WITH {_ATTEMPTS}, d AS (SELECT *, CAST(epoch(date_trunc('second', end_time)) - epoch(date_trunc('second', start_time)) AS BIGINT) AS seconds FROM attempts WHERE end_time IS NOT NULL)
SELECT project, operator_type, count(*) AS n, CAST(sum(seconds) AS BIGINT) AS total_seconds, max(seconds) AS max_seconds, quantile_cont(seconds, 0.5) AS median_seconds,
  arg_max(seconds, (end_time, job_id, scheduled_at, operator_name, attempt)) AS last_seconds FROM d GROUP BY ALL""",
)
def operator_durations(t):
    return E.durations(E.operator_runs(t.run_events_v))


def _job_durations_sql(keys: str) -> str:
    return f"""WITH {_ATTEMPTS}, d AS (SELECT *, date_trunc('day', end_time) AS day, CAST(epoch(date_trunc('second', end_time)) - epoch(date_trunc('second', start_time)) AS BIGINT) AS seconds FROM attempts WHERE end_time IS NOT NULL),
g AS (SELECT {keys}, count(*) AS n, CAST(sum(seconds) AS BIGINT) AS total_seconds, max(seconds) AS max_seconds, list(seconds ORDER BY seconds) AS sorted,
  arg_max(seconds, (end_time, scheduled_at, operator_name, attempt)) AS last_seconds FROM d GROUP BY {keys})
SELECT * EXCLUDE sorted, total_seconds / n AS mean_seconds, sorted[(n * 500 + 999) // 1000] AS p500_seconds, sorted[(n * 950 + 999) // 1000] AS p950_seconds FROM g"""


@query("job_durations", _job_durations_sql("project, job_id, operator_type"))
def job_durations(t):
    """Every job's durations, from partials per day as they would be stored."""
    return E.job_durations(E.duration_partials(E.operator_runs(t.run_events_v)))


@query("job_durations_daily", _job_durations_sql("project, job_id, operator_type, day"))
def job_durations_daily(t):
    return E.job_durations(E.duration_partials(E.operator_runs(t.run_events_v)), [*E.JOB_OPERATOR, "day"])


@query(
    "sla_flag",
    f"""WITH l AS (SELECT project, job_id, scheduled_at FROM run_events_v WHERE type = 'failure' UNION SELECT project, job_id + 3, scheduled_at FROM run_events_v WHERE type = 'failure')
SELECT DISTINCT {_RUN}, l.job_id IS NOT NULL AS sla_alert FROM run_events_v LEFT JOIN l USING ({_RUN})""",
)
def sla_flag(t):
    slas = "array(named_struct('job_id', job_id, 'scheduled_at', scheduled_at), named_struct('job_id', job_id + 3, 'scheduled_at', scheduled_at)) AS slas"
    events = t.run_events_v
    return E.sla_flags(events.select(*E.RUN).distinct(), events.where("type = 'failure'").selectExpr("project", slas))


@query("run_register", f"SELECT {_RUN}, min(event_time) AS registered_at, min(event_id) AS event_id FROM run_events_v GROUP BY ALL")
def run_register(t):
    return E.registrations(t.run_events_v)


# Sensor events with outcomes in between: purchases stand for a sensor's success.
_SENSORS = "SELECT event_id, project, namespace, job_id, event_time, scheduled_at, CASE WHEN type = 'job_success' THEN 'sensor_success' ELSE type END AS type, 'wait' AS operator_name FROM run_events_v WHERE type IN ('sensor_start', 'job_success', 'task_start')"


@query(
    "sensor_first_start",
    f"""WITH s AS ({_SENSORS}), p AS (SELECT *, lag(type) OVER (PARTITION BY {_RUN} ORDER BY event_time, event_id) AS before FROM s WHERE type LIKE 'sensor%')
SELECT {_RUN}, 'sensor' AS operator_type, operator_name, event_time, event_id FROM p WHERE type = 'sensor_start' AND (before IS NULL OR before <> 'sensor_start')""",
)
def sensor_first_start(t):
    return E.first_sensor_starts(t.sql(_SENSORS))


_CHANGES = f"{_TYPED}, c AS (SELECT {_RUN}, event_time, event_id, state, lag(state) OVER (PARTITION BY {_RUN} ORDER BY event_time, event_id) AS before FROM steps)"


@query("state_change_events", f"WITH {_CHANGES} SELECT {_RUN}, event_time, event_id, state FROM c WHERE before IS NULL OR before <> state")
def state_change_events(t):
    return E.state_changes(t.run_events_v)


@query("status_counters", f"WITH {_CHANGES} SELECT job_id, state, count(*) AS n FROM c WHERE before IS NULL OR before <> state GROUP BY ALL")
def status_counters(t):
    return E.status_counters(E.state_changes(t.run_events_v))


@query(
    "event_counters",
    f"WITH {_TYPED} SELECT project, namespace, op AS operator_type, CASE op WHEN 'job' THEN type ELSE substr(type, length(op) + 2) END AS event_type, operator_name, count(*) AS n FROM typed GROUP BY ALL",
)
def event_counters(t):
    return E.counters(t.run_events_v)


@query(
    "event_counter_windows",
    "SELECT date_trunc('hour', event_time) AS window_start, date_trunc('hour', event_time) + INTERVAL 1 HOUR AS window_end, project, type, count(*) AS n FROM run_events_v GROUP BY ALL",
)
def event_counter_windows(t):
    return E.windowed_counters(t.run_events_v)


# --- alerts -------------------------------------------------------------------------

_ALERTS = "SELECT event_id, project, namespace, job_id, event_time, scheduled_at, CASE WHEN type = 'sensor_start' AND event_id % 2 = 0 THEN 'sla_miss' ELSE type END AS type FROM run_events_v"
_ROUTED = f"""alerts AS ({_ALERTS}),
routed AS (SELECT a.*, split_part(channel, '://', 1) AS scheme, split_part(channel, '://', 2) AS route FROM alerts a JOIN job_alerts_v j ON j.job_id = a.job_id AND j.alert_on = a.type)"""


def _routed(t):
    hot = skew.hot_keys(t.events.selectExpr("user_id AS job_id"), ["job_id"])
    return A.routes(t.sql(_ALERTS), A.settings_of(with_alerts(t)), hot)


@query("alert_routes", f"WITH {_ROUTED} SELECT event_id, job_id, type, scheme, route FROM routed")
def alert_routes(t):
    return _routed(t).select("event_id", "job_id", "type", "scheme", "route")


@query(
    "alert_batches",
    f"""WITH {_ROUTED} SELECT time_bucket(INTERVAL 10 SECOND, event_time) AS flushed_from, scheme, route, count(*) AS n_alerts, min(event_id) AS first_event, max(event_id) AS last_event FROM routed GROUP BY ALL""",
)
def alert_batches(t):
    return A.batches(_routed(t))


@query(
    "alert_messages",
    f"""WITH {_ROUTED}, m AS (SELECT event_id, job_id, scheme, route, event_time, time_bucket(INTERVAL 10 SECOND, event_time) AS flushed_from FROM routed)
SELECT event_id, job_id, scheme, route, flushed_from, row_number() OVER (PARTITION BY scheme, route, flushed_from ORDER BY event_time, event_id) AS position FROM m""",
)
def alert_messages(t):
    return A.in_messages(_routed(t)).select("event_id", "job_id", "scheme", "route", "flushed_from", "position")


@query(
    "alert_truncate",
    f"""WITH {_ROUTED}, d AS (SELECT date_trunc('day', event_time) AS day, route, event_id, job_id, row_number() OVER (PARTITION BY date_trunc('day', event_time), route ORDER BY event_time, event_id) AS position FROM routed WHERE type = 'sla_miss')
SELECT day, route, event_id, job_id, CAST(position AS INTEGER) AS position, position = 8 AS is_cut FROM d WHERE position <= 8""",
)
def alert_truncate(t):
    breaches = _routed(t).where("type = 'sla_miss'").select(F.date_trunc("day", "event_time").alias("day"), "route", "event_time", "event_id", "job_id")
    return A.message_items(breaches, ["day", "route"], ["event_time", "event_id"]).drop("event_time")


# --- change feed --------------------------------------------------------------------


@query(
    "change_event_json",
    f"""WITH {_CHANGES} SELECT event_id, concat('{{"event_id":"', event_id, '","occurred_at":"', strftime(event_time, '%Y-%m-%dT%H:%M:%S.%gZ'), '","project":"', project,
  '","event_type":"job_', state, '","payload":{{"job_id":', job_id, ',"scheduled_at":"', strftime(scheduled_at, '%Y-%m-%dT%H:%M:%S.%gZ'), '"}}}}') AS value FROM c WHERE before IS NULL OR before <> state""",
)
def change_event_json(t):
    changes = E.state_changes(t.run_events_v)
    payload = F.struct("job_id", "scheduled_at")
    return changes.select(
        "event_id",
        feed.envelope(F.col("event_id").cast("string"), F.col("event_time"), F.col("project"), F.concat(F.lit("job_"), "state"), payload).alias("value"),
    )


@query(
    "export_window",
    """SELECT event_id, concat('{"event_id":', event_id, ',"user_id":', user_id, ',"event_type":"', event_type, '"}') AS value FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-15'""",
)
def export_window(t):
    """The rows of one run's window, written to the feed and read back."""
    return feed.export_window(
        t.spark, t.events, "ts", "2024-01-16 02:00:00", ["event_id", "user_id", "event_type"], version=2, size="24h", offset="-24h", unit="d"
    )

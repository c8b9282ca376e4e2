"""Run analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.operators import runs as R
from flowtables.queries.registry import query
from flowtables.queries.time import WIDE_SLOTS, add_months_sql

# Each job's calendar goes from its first to its last run; a job that never ran has its start date only.
SPANS_SQL = """spans AS (SELECT job_id, cron, coalesce(lo, start_at) AS lo, coalesce(hi, start_at) AS hi
  FROM jobs_v LEFT JOIN (SELECT job_id, min(scheduled_at) AS lo, max(scheduled_at) AS hi FROM runs_v GROUP BY job_id) USING (job_id))"""
LATEST_SQL = "latest AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY job_id, scheduled_at ORDER BY run_id DESC) AS rn FROM runs_v) WHERE rn = 1)"
EXPECTED_SQL = f"{WIDE_SLOTS}, {SPANS_SQL}, expected AS (SELECT job_id, slot AS scheduled_at FROM spans JOIN slots USING (cron) WHERE slot BETWEEN lo AND hi)"


def _expected(t):
    return R.expected(R.spans(t.jobs_v, t.runs_v), "lo", "hi")


@query("latest_run", f"WITH {LATEST_SQL} SELECT job_id, scheduled_at, run_id, state FROM latest")
def latest_run(t):
    return R.latest(t.runs_v).select("job_id", "scheduled_at", "run_id", "state")


@query("run_duplicates", "SELECT job_id, scheduled_at, count(*) AS copies FROM runs_v GROUP BY ALL HAVING count(*) > 1")
def run_duplicates(t):
    return R.duplicates(t.runs_v)


@query(
    "runs_merged",
    f"WITH {EXPECTED_SQL}, {LATEST_SQL} SELECT job_id, scheduled_at, coalesce(state, 'pending') AS state FROM expected LEFT JOIN latest USING (job_id, scheduled_at)",
)
def runs_merged(t):
    return R.merged(_expected(t), R.latest(t.runs_v))


@query(
    "runs_missing",
    f"WITH {EXPECTED_SQL} SELECT job_id, scheduled_at FROM expected e WHERE NOT EXISTS (SELECT 1 FROM runs_v r WHERE r.job_id = e.job_id AND r.scheduled_at = e.scheduled_at)",
)
def runs_missing(t):
    return R.missing(_expected(t), t.runs_v)


@query(
    "run_execution_time",
    f"WITH {EXPECTED_SQL}, {LATEST_SQL} SELECT job_id, scheduled_at, coalesce(start_time, scheduled_at) AS execution_time FROM expected LEFT JOIN latest USING (job_id, scheduled_at)",
)
def run_execution_time(t):
    return R.execution_times(_expected(t), R.latest(t.runs_v))


@query(
    "depends_on_past_gate",
    f"WITH {LATEST_SQL}, p AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY scheduled_at) AS previous_state FROM latest) SELECT job_id, scheduled_at, previous_state, coalesce(previous_state = 'success', true) AS may_run FROM p",
)
def depends_on_past_gate(t):
    return R.past_gate(R.latest(t.runs_v)).select("job_id", "scheduled_at", "previous_state", "may_run")


@query("runs_sorted", "SELECT run_id, job_id, scheduled_at, state FROM runs_v ORDER BY scheduled_at, job_id, run_id")
def runs_sorted(t):
    return R.sorted_by_schedule(t.runs_v.select("run_id", "job_id", "scheduled_at", "state"))


@query(
    "last_run",
    "SELECT job_id, run_id, scheduled_at, state FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY scheduled_at DESC, run_id DESC) AS rn FROM runs_v) WHERE rn = 1",
)
def last_run(t):
    return R.last_run(t.runs_v.select("job_id", "run_id", "scheduled_at", "state"))


@query("schedule_delay", "SELECT run_id, CAST(epoch(start_time) - epoch(scheduled_at) AS BIGINT) AS delay_seconds FROM runs_v")
def schedule_delay(t):
    return t.runs_v.select("run_id", (F.unix_timestamp("start_time") - F.unix_timestamp("scheduled_at")).alias("delay_seconds"))


def with_alerts(t):
    """Jobs with their alert settings as stored: an array of (on, channels, config)."""
    alert = "named_struct('on', {}, 'channels', array({}), 'config', map({}))"
    sla = alert.format("'sla_miss'", "concat('slack://#c', job_id % 5)", "'duration', '2h'")
    failure = alert.format("'failure'", "'pagerduty://#svc'", "'note', 'page'")
    return t.jobs_v.selectExpr("job_id", f"array_compact(array(IF(job_id % 3 = 0, {failure}, NULL), IF(job_id % 2 = 0, {sla}, NULL))) AS alerts")


def _runs_with_sla(t):
    sla = R.with_sla_seconds(with_alerts(t)).select("job_id", "sla_seconds")
    return t.runs_v.drop("sla_seconds").join(sla, "job_id")


NOW = "TIMESTAMP '1999-06-01 04:00:00'"
_BREACH_SQL = f"breach AS (SELECT *, CAST(epoch(least(end_time, {NOW})) - epoch(start_time) - sla_seconds AS BIGINT) AS breach_seconds FROM runs_v WHERE sla_seconds > 0)"


@query(
    "sla_breach",
    f"WITH {_BREACH_SQL} SELECT run_id, CASE WHEN end_time < TIMESTAMP '3000-01-01' THEN end_time END AS ended_at, breach_seconds, breach_seconds > 0 AS breached FROM breach",
)
def sla_breach(t):
    return R.sla_breach(_runs_with_sla(t), NOW).select("run_id", R.end_or_null().alias("ended_at"), "breach_seconds", "breached")


@query(
    "sla_trend",
    f"""WITH {_BREACH_SQL} SELECT date_trunc('day', scheduled_at) AS day, project, namespace, count(*) AS n_runs, CAST(sum(CASE WHEN breach_seconds > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_breached
FROM breach JOIN jobs_v USING (job_id) GROUP BY GROUPING SETS ((date_trunc('day', scheduled_at), project, namespace), (date_trunc('day', scheduled_at), project), (date_trunc('day', scheduled_at)))""",
)
def sla_trend(t):
    # Runs are counted per job and day first, so that the join and the roll-up see few rows.
    per_job = R.sla_breach(_runs_with_sla(t), NOW).groupBy(F.date_trunc("day", "scheduled_at").alias("day"), "job_id").agg(
        F.count("*").alias("n"), F.count_if("breached").alias("b")
    )
    rows = per_job.join(t.jobs_v.select("job_id", "project", "namespace"), "job_id")
    per_tenant = rows.groupBy("day", "project", "namespace").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    sets = per_tenant.groupingSets([["day", "project", "namespace"], ["day", "project"], ["day"]], "day", "project", "namespace")
    return sets.agg(F.sum("n").alias("n_runs"), F.sum("b").alias("n_breached"))


# --- sensors ------------------------------------------------------------------------

SENSORS_SQL = f"""{EXPECTED_SQL},
numbered AS (SELECT *, row_number() OVER w AS n, lag(slot) OVER w AS before FROM slots WINDOW w AS (PARTITION BY cron ORDER BY slot)),
paired AS (SELECT w.job_id, w.scheduled_at, e.src AS upstream_id, u.cron AS up_cron, CASE WHEN u.job_id % 13 <> 6 THEN u.start_at END AS up_start, d.w_version, d.w_size FROM expected w JOIN edges_v e ON e.dst = w.job_id JOIN jobs_v u ON u.job_id = e.src JOIN jobs_v d ON d.job_id = w.job_id),
timed AS (SELECT p.*, n.slot AS last_upstream, n.before AS before_upstream, n.n AS last_n FROM paired p ASOF JOIN numbered n ON p.up_cron = n.cron AND p.scheduled_at >= n.slot)"""


@query("upstream_asof", f"WITH {SENSORS_SQL} SELECT job_id, scheduled_at, upstream_id, last_upstream, before_upstream FROM timed")
def upstream_asof(t):
    times = R.upstream_times(_expected(t), t.edges_v, t.jobs_v)
    return times.select("job_id", "scheduled_at", "upstream_id", "last_upstream", "before_upstream")


@query(
    "sensor_ready",
    f"""WITH {SENSORS_SQL}, {LATEST_SQL},
sized AS (SELECT *, CASE WHEN w_size = '' AND w_version = 1 THEN 24 ELSE coalesce(try_cast(regexp_extract(w_size, '([0-9]+)h', 1) AS BIGINT), 0) END AS sh, coalesce(try_cast(regexp_extract(w_size, '^([0-9]+)M', 1) AS BIGINT), 0) AS sm FROM timed),
moved AS (SELECT *, last_upstream - to_hours(CASE WHEN w_version = 1 THEN sh + 720 * sm ELSE sh END) AS b FROM sized),
ranges AS (SELECT job_id, scheduled_at, upstream_id, up_cron, up_start, last_n, last_upstream AS hi, CASE WHEN w_version = 1 THEN b ELSE {add_months_sql('b', '-sm')} END AS lo FROM moved),
firsts AS (SELECT r.*, s.slot AS first_needed, s.n AS first_n FROM ranges r ASOF LEFT JOIN numbered s ON r.up_cron = s.cron AND r.lo < s.slot),
upstreams AS (SELECT DISTINCT upstream_id, up_cron FROM paired),
succeeded AS (SELECT upstream_id, n, sum(CASE WHEN l.state = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY upstream_id ORDER BY n) AS so_far
  FROM upstreams u JOIN numbered s ON s.cron = u.up_cron LEFT JOIN latest l ON l.job_id = u.upstream_id AND l.scheduled_at = s.slot),
counted AS (SELECT f.job_id, f.scheduled_at, f.upstream_id, coalesce(first_needed < up_start OR hi < up_start, true) AS refused, greatest(last_n - first_n + 1, 0) AS n_expected,
    CASE WHEN last_n >= first_n THEN CAST(b.so_far - coalesce(a.so_far, 0) AS BIGINT) ELSE 0 END AS n_success
  FROM firsts f LEFT JOIN succeeded b ON b.upstream_id = f.upstream_id AND b.n = f.last_n LEFT JOIN succeeded a ON a.upstream_id = f.upstream_id AND a.n = f.first_n - 1)
SELECT job_id, scheduled_at, upstream_id, CASE WHEN NOT refused THEN n_expected END AS n_expected, CASE WHEN NOT refused THEN n_success END AS n_success,
  CASE WHEN refused THEN 'error' WHEN n_expected = n_success THEN 'ready' ELSE 'waiting' END AS status FROM counted""",
)
def sensor_ready(t):
    jobs = t.jobs_v.withColumn("start_at", F.expr("IF(job_id % 13 <> 6, start_at, NULL)"))
    return R.readiness(_expected(t), t.edges_v, jobs, R.latest(t.runs_v))

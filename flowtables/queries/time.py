"""Windows, durations, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtables.functions import cron, durations, windows
from flowtables.operators import skew
from flowtables.plans import incremental
from flowtables.queries.registry import query

CAL_START, CAL_END = "2024-01-01", "2024-01-31"

# --- SQL pieces shared by the twins -------------------------------------------------


def add_months_sql(t: str, m: str) -> str:
    return (
        f"(date_trunc('month', {t}) + to_months(CAST({m} AS INTEGER)) + to_days(CAST(day({t}) - 1 AS INTEGER))"
        f" + ({t} - date_trunc('day', {t})))"
    )


def _hours(c: str) -> str:
    return f"coalesce(try_cast(regexp_extract({c}, '([0-9]+)h', 1) AS BIGINT), 0)"


def _months(c: str) -> str:
    return f"coalesce(try_cast(regexp_extract({c}, '^([-+]?[0-9]+)M', 1) AS BIGINT), 0)"


def _sign(c: str) -> str:
    return f"(CASE WHEN {c} LIKE '-%' THEN -1 ELSE 1 END)"


# window settings of a run as numbers: months and hours (version 2), hours only (version 1)
SETTINGS_SQL = f"""settings AS (
  SELECT *, {_months('w_size')} AS sm, {_sign('w_size')} * {_hours('w_size')} AS sh,
         {_months('w_offset')} AS om, {_sign('w_offset')} * {_hours('w_offset')} AS oh,
         CASE WHEN w_size = '' THEN 24 WHEN w_size LIKE '%M%' THEN {_months('w_size')} * 720 + {_hours('w_size')} ELSE {_sign('w_size')} * {_hours('w_size')} END AS s1,
         CASE WHEN w_offset = '' THEN 0 WHEN w_offset LIKE '%M%' THEN {_months('w_offset')} * 720 + {_hours('w_offset')} ELSE {_sign('w_offset')} * {_hours('w_offset')} END AS o1
  FROM timed_runs_v)"""

V2_SQL = f"""v2_cut AS (
  SELECT *, CASE w_truncate WHEN 'h' THEN date_trunc('hour', at_time) WHEN 'd' THEN date_trunc('day', at_time)
                 WHEN 'w' THEN date_trunc('week', at_time) WHEN 'M' THEN date_trunc('month', at_time) ELSE at_time END + to_hours(oh) AS c2
  FROM settings),
v2_end AS (SELECT *, {add_months_sql('c2', 'om')} AS e2 FROM v2_cut),
v2_back AS (SELECT *, e2 - to_hours(sh) AS b2 FROM v2_end),
v2 AS (SELECT *, {add_months_sql('b2', '-sm')} AS s2 FROM v2_back)"""

V1_SQL = """v1_cut AS (
  SELECT *, CASE w_truncate WHEN 'h' THEN date_trunc('hour', at_time) WHEN 'd' THEN date_trunc('day', at_time)
                 WHEN 'w' THEN date_trunc('day', at_time) + to_days(CAST(7 - dayofweek(at_time) AS INTEGER)) ELSE at_time END AS c1,
         date_trunc('month', at_time) + to_months(CAST(trunc(o1 / 720.0) AS INTEGER)) AS m1
  FROM v2),
v1 AS (
  SELECT *, CASE WHEN w_truncate = 'M' THEN m1 + to_months(1) - to_days(1) ELSE c1 + to_hours(o1) END AS e1,
         CASE WHEN w_truncate = 'M' THEN m1 - to_months(CAST(greatest(trunc(s1 / 720.0) - 1, 0) AS INTEGER)) ELSE c1 + to_hours(o1) - to_hours(s1) END AS s1t
  FROM v1_cut)"""

# schedule times of the registry's four expressions in a closed range
SLOTS_SQL = """plans AS (
  SELECT * FROM (VALUES ('0 2 * * *', [2], NULL), ('@daily', [0], NULL), ('0 */6 * * *', [0, 6, 12, 18], NULL),
                        ('0 2 2,11,19,26 * *', [2], [2, 11, 19, 26])) t(cron, hours, doms)),
slots AS (
  SELECT cron, d + to_hours(CAST(h AS BIGINT)) AS slot
  FROM (SELECT cron, unnest(hours) AS h, d, doms FROM plans, (SELECT unnest(generate_series(TIMESTAMP '{lo}', TIMESTAMP '{hi}', INTERVAL 1 DAY)) AS d))
  WHERE doms IS NULL OR list_contains(doms, CAST(day(d) AS INTEGER)))"""


def slots_sql(lo: str, hi: str) -> str:
    return SLOTS_SQL.format(lo=lo, hi=hi)


WIDE_SLOTS = slots_sql("1994-10-01", "2002-03-01")

# previous / next schedule time for any (expression, time) by as-of joins on the slots
NEIGHBOURS_SQL = f"""{WIDE_SLOTS},
numbered AS (SELECT *, lag(slot) OVER w AS before, lag(slot, 2) OVER w AS before2, lead(slot) OVER w AS after FROM slots WINDOW w AS (PARTITION BY cron ORDER BY slot))"""


# --- windows ------------------------------------------------------------------------


def _timed_runs(t, plan: bool = False):
    """Runs with their job's settings, parsed once per job before the join."""
    jobs = t.jobs_v.select("job_id", "cron", "w_size", "w_offset", "w_truncate")
    jobs = cron.with_plan(jobs, "cron") if plan else windows.with_settings(jobs, "w_size", "w_offset", "w_truncate")
    runs = t.sql("SELECT run_id, job_id, scheduled_at, scheduled_at + (run_id % 50000) * INTERVAL '1' SECOND AS at_time FROM runs_v")
    return skew.join_many_to_one(runs, jobs, ["job_id"])


@query(
    "window_v2",
    f"WITH {SETTINGS_SQL}, {V2_SQL} SELECT run_id, at_time, s2 AS window_start, e2 AS window_end FROM v2",
)
def window_v2(t):
    return windows.with_bounds(_timed_runs(t), "at_time", 2).select("run_id", "at_time", "window_start", "window_end")


@query(
    "window_v1",
    f"WITH {SETTINGS_SQL}, {V2_SQL}, {V1_SQL} SELECT run_id, at_time, s1t AS window_start, e1 AS window_end FROM v1",
)
def window_v1(t):
    return windows.with_bounds(_timed_runs(t), "at_time", 1).select("run_id", "at_time", "window_start", "window_end")


@query(
    "window_dispatch",
    f"""WITH {SETTINGS_SQL}, {V2_SQL}, {V1_SQL}, pick AS (SELECT *, run_id % 4 AS version FROM v1)
SELECT run_id, version, CASE WHEN version IN (0, 1) THEN s1t WHEN version = 2 THEN s2 END AS window_start,
       CASE WHEN version IN (0, 1) THEN e1 WHEN version = 2 THEN e2 END AS window_end,
       CASE WHEN version = 3 THEN 'no window rules of version 3' END AS error FROM pick""",
)
def window_dispatch(t):
    runs = _timed_runs(t).withColumn("version", F.col("run_id") % 4)
    return windows.with_bounds(runs, "at_time", "version").select(
        "run_id", "version", "window_start", "window_end", windows.version_error(F.col("version")).alias("error")
    )


_PARTS_SQL = """parts AS (
  SELECT *, duration LIKE '%M%' AS has_m, regexp_replace(duration, '^[^M]*M', '') AS tail, try_cast(regexp_extract(duration, '^([-+]?[0-9]+)M', 1) AS BIGINT) AS m FROM duration_texts_v),
clocks AS (
  SELECT *, CASE WHEN NOT has_m THEN duration WHEN tail = '' THEN '0' ELSE tail END AS clock FROM parts),
sized AS (
  SELECT *, CASE WHEN clock = '0' OR regexp_full_match(clock, '[-+]?([0-9]+h)?([0-9]+m)?([0-9]+s)?') THEN
    (CASE WHEN clock LIKE '-%' THEN -1 ELSE 1 END) * 1000000 * (coalesce(try_cast(regexp_extract(clock, '([0-9]+)h', 1) AS BIGINT), 0) * 3600
      + coalesce(try_cast(regexp_extract(clock, '([0-9]+)m', 1) AS BIGINT), 0) * 60 + coalesce(try_cast(regexp_extract(clock, '([0-9]+)s', 1) AS BIGINT), 0)) END AS micros FROM clocks)"""


@query(
    "duration_parse_v2",
    f"""WITH {_PARTS_SQL} SELECT job_id, duration, CAST(CASE WHEN micros IS NULL THEN NULL WHEN has_m THEN m ELSE 0 END AS BIGINT) AS months,
       CAST(CASE WHEN has_m AND m < 0 THEN -micros ELSE micros END AS BIGINT) AS micros, micros IS NOT NULL AND (NOT has_m OR m IS NOT NULL) AS is_valid FROM sized""",
)
def duration_parse_v2(t):
    parsed = durations.parse_v2(t.duration_texts_v, {"d": "duration"})
    return parsed.select(
        "job_id",
        "duration",
        F.col("d_months").cast("bigint").alias("months"),
        F.col("d_micros").alias("micros"),
        F.col("d_micros").isNotNull().alias("is_valid"),
    )


@query(
    "duration_parse_v1",
    f"""WITH {_PARTS_SQL} SELECT job_id, duration, CAST(CASE WHEN has_m THEN m * 2592000000000 + micros ELSE micros END AS BIGINT) AS micros FROM sized""",
)
def duration_parse_v1(t):
    return durations.parse_v1(t.duration_texts_v, {"micros": "duration"})


@query(
    "window_validate",
    f"""WITH {_PARTS_SQL}, named AS (SELECT *, CASE job_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'd' WHEN 2 THEN 'M' WHEN 3 THEN 'y' ELSE 'h' END AS unit FROM sized)
SELECT job_id, duration, unit, concat_ws('; ',
  CASE WHEN unit = 'y' THEN 'truncate_to: must be one of h, d, w, M' END,
  CASE WHEN micros IS NULL THEN 'offset: not a duration' END,
  CASE WHEN micros IS NULL THEN 'size: not a duration' WHEN duration LIKE '-%' THEN 'size: cannot be negative' END) AS errors FROM named""",
)
def window_validate(t):
    unit = F.element_at(F.array(*map(F.lit, ("", "d", "M", "y", "h"))), (F.col("job_id") % 5 + 1).cast("int"))
    checked = windows.with_errors(t.duration_texts_v.withColumn("unit", unit), "duration", "duration", "unit")
    return checked.withColumn("errors", F.array_join("errors", "; "))


@query(
    "end_run_date",
    f"""WITH {SETTINGS_SQL}, moved AS (SELECT *, at_time + to_hours(sh) AS m0 FROM settings)
SELECT run_id, at_time, CASE WHEN w_size <> '' THEN {add_months_sql('m0', 'sm')} - to_hours(24) END AS end_run FROM moved""",
)
def end_run_date(t):
    runs = t.timed_runs_v.select("run_id", "at_time", "w_size")
    return windows.with_last_covered_run(runs, "at_time", "w_size", "end_run").drop("w_size")


# --- schedules ----------------------------------------------------------------------


@query(
    "expected_runs",
    f"WITH {slots_sql(CAL_START, CAL_END)} SELECT job_id, slot AS scheduled_at FROM jobs_v JOIN slots USING (cron) WHERE slot <= TIMESTAMP '{CAL_END}'",
)
def expected_runs(t):
    jobs = t.jobs_v.select("job_id", "cron")
    return cron.explode_schedule(jobs, "cron", f"'{CAL_START}'", f"'{CAL_END}'").select("job_id", "scheduled_at")


@query(
    "cron_next",
    f"""WITH {WIDE_SLOTS} SELECT r.run_id, r.cron, r.at_time, s.slot AS next_at FROM timed_runs_v r ASOF LEFT JOIN slots s ON r.cron = s.cron AND r.at_time < s.slot""",
)
def cron_next(t):
    return _timed_runs(t, plan=True).selectExpr("run_id", "cron", "at_time", f"{cron.next_time('plan', 'at_time')} AS next_at")


@query(
    "cron_prev",
    f"""WITH {WIDE_SLOTS} SELECT r.run_id, r.cron, r.at_time, s.slot AS prev_at FROM timed_runs_v r ASOF LEFT JOIN slots s ON r.cron = s.cron AND r.at_time > s.slot""",
)
def cron_prev(t):
    return _timed_runs(t, plan=True).selectExpr("run_id", "cron", "at_time", f"{cron.prev_time('plan', 'at_time')} AS prev_at")


@query(
    "logical_time",
    f"""WITH {WIDE_SLOTS} SELECT r.run_id, r.scheduled_at, p.slot AS logical_at, n.slot AS run_scheduled_at
FROM timed_runs_v r ASOF LEFT JOIN slots p ON r.cron = p.cron AND r.scheduled_at > p.slot ASOF LEFT JOIN slots n ON r.cron = n.cron AND r.scheduled_at < n.slot""",
)
def logical_time(t):
    return _timed_runs(t, plan=True).selectExpr(
        "run_id",
        "scheduled_at",
        f"{cron.prev_time('plan', 'scheduled_at')} AS logical_at",
        f"{cron.next_time('plan', 'scheduled_at')} AS run_scheduled_at",
    )


@query(
    "execution_range",
    f"""WITH {NEIGHBOURS_SQL},
asked AS (SELECT run_id, cron, at_time - INTERVAL 3 DAY AS lo, CASE WHEN run_id % 2 = 0 THEN scheduled_at ELSE at_time END AS hi FROM timed_runs_v)
SELECT a.run_id, a.lo AS range_start, a.hi AS range_end, s.slot AS execution_start, e.before AS execution_end
FROM asked a ASOF LEFT JOIN slots s ON a.cron = s.cron AND a.lo > s.slot ASOF LEFT JOIN numbered e ON a.cron = e.cron AND a.hi >= e.slot""",
)
def execution_range(t):
    asked = _timed_runs(t, plan=True).selectExpr(
        "run_id", "plan", "at_time - INTERVAL 3 DAYS AS lo", "IF(run_id % 2 = 0, scheduled_at, at_time) AS hi"
    )
    # The latest schedule time not after the end; execution time is the one before it.
    asked = asked.selectExpr("*", f"IF({cron.matches('plan', 'hi')}, hi, {cron.prev_time('plan', 'hi')}) AS latest")
    return asked.selectExpr(
        "run_id",
        "lo AS range_start",
        "hi AS range_end",
        f"{cron.prev_time('plan', 'lo')} AS execution_start",
        f"{cron.prev_time('plan', 'latest')} AS execution_end",
    )


@query(
    "cron_descriptor",
    """WITH named AS (SELECT job_id, CASE WHEN job_id % 8 = 7 THEN '@weekly' WHEN job_id % 8 = 6 THEN '@hourly' WHEN job_id % 16 = 3 THEN '@every 1h' ELSE cron END AS expr FROM jobs_v)
SELECT job_id, expr, CASE expr WHEN '@daily' THEN '0 0 * * *' WHEN '@weekly' THEN '0 0 * * 0' WHEN '@hourly' THEN '0 * * * *' ELSE expr END AS fields,
       CASE WHEN expr = '@every 1h' THEN 'relative interval has no fixed calendar' END AS error FROM named""",
)
def cron_descriptor(t):
    i = F.col("job_id")
    expr = F.when(i % 8 == 7, "@weekly").when(i % 8 == 6, "@hourly").when(i % 16 == 3, "@every 1h").otherwise(F.col("cron"))
    jobs = cron.with_plan(t.jobs_v.select("job_id", expr.alias("expr")), "expr")
    return jobs.selectExpr("job_id", "expr", f"{cron.normalize('expr')} AS fields", f"{cron.error('expr', 'plan')} AS error")


# --- bounded reads ------------------------------------------------------------------


@query(
    "window_scan",
    """SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-14 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00'""",
)
def window_scan(t):
    """The read of one run: its bounds are literals, so the filter reaches the parquet scan."""
    bounds = incremental.bounds_of_run(t.spark, "2024-01-16 02:00:00", version=2, size="24h", offset="-24h", unit="d")
    return incremental.read_window(t.events, "ts", *bounds).select("event_id", "ts", "user_id", "value")


@query(
    "window_incremental_agg",
    """WITH runs AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 02:00:00', TIMESTAMP '2024-01-31 02:00:00', INTERVAL 1 DAY)) AS scheduled_at),
bounds AS (SELECT scheduled_at, date_trunc('day', scheduled_at) - INTERVAL 48 HOUR AS lo, date_trunc('day', scheduled_at) - INTERVAL 24 HOUR AS hi FROM runs)
SELECT scheduled_at, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS sum_value
FROM bounds JOIN events ON ts >= lo AND ts < hi GROUP BY scheduled_at""",
)
def window_incremental_agg(t):
    """Flagship: schedule, data windows and the aggregate of each window in one plan."""
    runs = incremental.run_windows(
        t.spark, cron_expr="0 2 * * *", start="2024-01-01", end="2024-01-31 02:00:00", version=2, size="24h", offset="-24h", unit="d"
    )
    return incremental.aggregate_windows(
        t.events.select("ts", "value"),
        "ts",
        runs,
        counts={"n_events": F.lit(1)},
        sums={"sum_value": F.col("value").cast("decimal(18,4)")},
    ).select("scheduled_at", "n_events", F.col("sum_value").cast("double").alias("sum_value"))

"""Expected and actual runs: merge, gaps, readiness of upstreams, gates, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables import session
from flowtables.functions import cron, durations, windows
from flowtables.operators import skew

FOREVER = "TIMESTAMP '3000-01-01 00:00:00'"
RUN = ["job_id", "scheduled_at"]


def spans(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds lo and hi, the first and last schedule time the job has run for; its start date for both where it never ran.

    A job with neither has NULL bounds and so no calendar.
    """
    seen = runs.groupBy("job_id").agg(F.min("scheduled_at").alias("lo"), F.max("scheduled_at").alias("hi"))
    return jobs.join(seen, "job_id", "left").withColumns({"lo": F.coalesce("lo", "start_at"), "hi": F.coalesce("hi", "start_at")})


def expected(jobs: DataFrame, start: str, end: str) -> DataFrame:
    """(job_id, scheduled_at) of every run due in the closed range; ``jobs`` has job_id and cron.

    ``start`` and ``end`` are SQL over the columns of ``jobs``, such as the bounds of ``spans``.
    """
    bounded = jobs.selectExpr("job_id", "cron", f"{start} AS lo", f"{end} AS hi")
    return cron.explode_schedule(bounded, "cron", "lo", "hi").select(*RUN)


def latest(runs: DataFrame, by: str = "run_id") -> DataFrame:
    """The newest row per (job, schedule time), combined before the shuffle."""
    rest = [c for c in runs.columns if c not in RUN]
    return runs.groupBy(*RUN).agg(F.max_by(F.struct(*rest), F.col(by)).alias("r")).select(*RUN, "r.*")


def duplicates(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*RUN).agg(F.count("*").alias("copies")).where("copies > 1")


def merged(expected_runs: DataFrame, actual: DataFrame) -> DataFrame:
    """Every expected run with its actual state; pending when nothing ran. ``actual`` is unique per run."""
    return expected_runs.join(actual.select(*RUN, "state"), RUN, "left").select(*RUN, F.coalesce("state", F.lit("pending")).alias("state"))


def missing(expected_runs: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected runs that do not exist yet."""
    return expected_runs.join(actual.select(*RUN).distinct(), RUN, "left_anti")


def execution_times(expected_runs: DataFrame, actual: DataFrame) -> DataFrame:
    """When a run executes: the start of its actual run, else its schedule time."""
    return expected_runs.join(actual.select(*RUN, "start_time"), RUN, "left").select(
        *RUN, F.coalesce("start_time", "scheduled_at").alias("execution_time")
    )


def past_gate(runs: DataFrame) -> DataFrame:
    """Whether a run that depends on the past may go: the run scheduled before it succeeded, or there is none."""
    with_previous = skew.previous_value(runs, ["job_id"], ["scheduled_at"], F.col("state"), "previous_state")
    return with_previous.withColumn("may_run", F.coalesce(F.col("previous_state") == "success", F.lit(True)))


def last_run(runs: DataFrame) -> DataFrame:
    """The last run per job."""
    rest = [c for c in runs.columns if c != "job_id"]
    order = F.struct("scheduled_at", "run_id")
    return runs.groupBy("job_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("job_id", "r.*")


def sorted_by_schedule(runs: DataFrame) -> DataFrame:
    return runs.orderBy("scheduled_at", "job_id", "run_id")


def with_sla_seconds(jobs: DataFrame, alerts: str = "alerts", into: str = "sla_seconds") -> DataFrame:
    """Adds the SLA of a job: the duration of its first ``sla_miss`` alert that has one, in seconds; 0 means none.

    ``alerts`` is an array of (on, channels, config).
    """
    chosen = f"get(filter({alerts}, __a -> __a.on = 'sla_miss' AND map_contains_key(__a.config, 'duration')), 0).config['duration']"
    step = jobs.selectExpr("*", f"{chosen} AS __sla")
    return step.selectExpr(*jobs.columns, f"CAST(coalesce(({durations.clock_micros('__sla')}) DIV 1000000, 0) AS BIGINT) AS {into}")


def sla_breach(runs: DataFrame, now: str) -> DataFrame:
    """Seconds beyond the SLA, for runs that have one; an open run counts up to ``now``."""
    seconds = F.unix_timestamp(F.least(F.col("end_time"), F.expr(now))) - F.unix_timestamp("start_time") - F.col("sla_seconds")
    return runs.where("sla_seconds > 0").withColumn("breach_seconds", seconds).withColumn("breached", seconds > 0)


def end_or_null(column: str = "end_time") -> Column:
    """The sentinel of an open run is not shown."""
    return F.when(F.col(column) < F.expr(FOREVER), F.col(column))


# --- sensors ------------------------------------------------------------------------


def upstream_times(runs: DataFrame, edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each run and upstream, the last upstream schedule time not after it and the one before.

    They follow from the upstream's expression and the run's time: no as-of join is needed.
    """
    plans = cron.with_plan(jobs.selectExpr("job_id AS upstream_id", "cron AS up_cron", "start_at AS up_start"), "up_cron")
    pairs = edges.selectExpr("dst AS job_id", "src AS upstream_id").join(plans, "upstream_id")
    step = runs.select(*RUN).join(pairs, "job_id")
    at = f"IF({cron.matches('plan', 'scheduled_at')}, scheduled_at, {cron.prev_time('plan', 'scheduled_at')})"
    step = step.selectExpr("*", f"{at} AS last_upstream")
    return step.selectExpr("*", f"{cron.prev_time('plan', 'last_upstream')} AS before_upstream")


def readiness(runs: DataFrame, edges: DataFrame, jobs: DataFrame, actual: DataFrame) -> DataFrame:
    """ready / waiting / error for each run and upstream, with the expected and successful run counts.

    The upstream runs a run needs are those scheduled in (start, end], the downstream's window, without
    offset and truncation, at the upstream's last schedule time. All must have succeeded; an empty range is
    ready; a range before the upstream's start date, or an upstream without one, is an error. Counts come from running totals over the
    upstream's calendar, looked up at both ends of each distinct range, so no run is paired with a range.
    """
    settings = windows.with_settings(jobs.selectExpr("job_id", "w_version", "w_size"), "w_size", "''", "''")
    step = upstream_times(runs, edges, jobs).join(settings, "job_id")
    step = windows.with_bounds(step, "last_upstream", "w_version", "lo", "hi")
    step = step.selectExpr("*", f"{cron.next_time('plan', 'lo')} AS first_needed")
    sensors = step.selectExpr(*RUN, "upstream_id", "lo", "hi", "coalesce(hi IS NULL OR first_needed < up_start OR hi < up_start, true) AS refused")
    # Read four times below, and its bounds are join keys: computed once and stored.
    sensors = session.cut_lineage(sensors)

    ranges = sensors.where("NOT refused").select("upstream_id", "lo", "hi").distinct()
    spans = ranges.groupBy("upstream_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    calendar = cron.explode_schedule(
        spans.join(jobs.selectExpr("job_id AS upstream_id", "cron"), "upstream_id"), "cron", "lo", "hi", "at"
    ).select("upstream_id", "at")
    done = actual.where("state = 'success'").selectExpr("job_id AS upstream_id", "scheduled_at AS at", "1L AS n_success")
    points = calendar.join(done, ["upstream_id", "at"], "left").selectExpr(
        "upstream_id", "at", "1L AS n_expected", "coalesce(n_success, 0L) AS n_success"
    )
    points = session.cut_lineage(points)
    probes = ranges.selectExpr(
        "upstream_id", "lo", "hi", "explode(array(named_struct('at', lo, 'sign', -1L), named_struct('at', hi, 'sign', 1L))) AS p", "true AS inclusive"
    ).selectExpr("upstream_id", "p.at", "lo", "hi", "p.sign", "inclusive")
    totals = skew.sums_at(points, probes, ["upstream_id"], "at", ["n_expected", "n_success"])
    counts = totals.groupBy("upstream_id", "lo", "hi").agg(
        F.sum(F.expr("sign * n_expected")).alias("n_expected"), F.sum(F.expr("sign * n_success")).alias("n_success")
    )
    return sensors.join(counts, ["upstream_id", "lo", "hi"], "left").selectExpr(
        *RUN,
        "upstream_id",
        "n_expected",
        "n_success",
        "CASE WHEN refused THEN 'error' WHEN n_expected = n_success THEN 'ready' ELSE 'waiting' END AS status",
    )

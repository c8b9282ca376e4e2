"""Backfills: validation, planning, progress, configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtables import session
from flowtables.functions import cron
from flowtables.functions import names as N
from flowtables.operators import skew

TENANT_JOB = ["project", "job_id"]


def runs_of(replays: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every run a replay covers: the schedule times of its job in its closed range."""
    plans = jobs.select("job_id", "cron")
    wanted = replays.select("replay_id", "job_id", "start_time", "end_time").join(plans, "job_id")
    return cron.explode_schedule(wanted, "cron", "start_time", "end_time").select("replay_id", "job_id", "scheduled_at")


def conflicts(new: DataFrame, ongoing: DataFrame) -> DataFrame:
    """How many other ongoing replays of the same job overlap each new one (closed intervals).

    starts not after my end, minus ends before my start: two running totals, so no two replays are paired.
    """
    points = ongoing.selectExpr(*TENANT_JOB, "start_time AS at", "1L AS n_start", "0L AS n_end").unionByName(
        ongoing.selectExpr(*TENANT_JOB, "end_time AS at", "0L AS n_start", "1L AS n_end")
    )
    probes = new.selectExpr(
        *TENANT_JOB,
        "replay_id",
        "explode(array(named_struct('at', end_time, 'inclusive', true), named_struct('at', start_time, 'inclusive', false))) AS p",
    ).selectExpr(*TENANT_JOB, "replay_id", "p.at", "p.inclusive")
    totals = skew.sums_at(points, probes, TENANT_JOB, "at", ["n_start", "n_end"])
    overlapping = totals.groupBy("replay_id").agg(F.sum(F.expr("IF(inclusive, n_start, -n_end)")).alias("n"))
    itself = ongoing.select("replay_id", F.lit(1).alias("self"))
    return overlapping.join(itself, "replay_id", "left").selectExpr("replay_id", "n - coalesce(self, 0) AS n_conflicts")


def run_conflicts(new: DataFrame, runs: DataFrame) -> DataFrame:
    """How many queued or running runs of the job lie in each new replay's range."""
    points = runs.where("state IN ('queued', 'running')").selectExpr("job_id", "scheduled_at AS at", "1L AS n")
    probes = new.selectExpr(
        "job_id",
        "replay_id",
        "explode(array(named_struct('at', end_time, 'inclusive', true), named_struct('at', start_time, 'inclusive', false))) AS p",
    ).selectExpr("job_id", "replay_id", "p.at", "p.inclusive")
    totals = skew.sums_at(points, probes, ["job_id"], "at", ["n"])
    return totals.groupBy("replay_id").agg(F.sum(F.expr("IF(inclusive, n, -n)")).alias("n_conflicts"))


def date_errors(replays: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    """A replay may not begin before its job nor end after now or the job's end; its job must be known."""
    limits = jobs.selectExpr("job_id", "start_at", "end_at", "true AS known")
    return replays.join(limits, "job_id", "left").selectExpr(
        "replay_id",
        f"""CASE WHEN known IS NULL THEN 'unknown job' WHEN start_time < start_at THEN 'begins before the job' WHEN end_time > least({now}, coalesce(end_at, {now})) THEN 'ends too late' END AS error""",
    )


def run_config(runs: DataFrame, replays: DataFrame, config: str) -> DataFrame:
    """Configuration of each run: of all replays whose closed range holds it, the latest created wins per key.

    ``config`` is a map column. A replay's range becomes a few aligned time blocks, and each block keeps
    only its latest value per key; a run then looks up the blocks around its schedule time. Neither many
    replays over one moment nor a long range multiplies anything.

    The entries are numbered in the order in which they win, so that the latest is the largest of plain numbers: those are
    aggregated in hash tables as large as the result, where whole entries would be sorted in the tasks that read them.
    """
    entries = replays.selectExpr("job_id", "start_time", "end_time", "created_at", "replay_id", f"explode({config}) AS (key, value)")
    order = ["created_at", "replay_id", "value"]
    numbered = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("turn", F.monotonically_increasing_id())
    numbered = session.cut_lineage(numbered.select("job_id", "start_time", "end_time", "key", "value", "turn"))
    # Of entries over the same range only the latest can win.
    ranges = numbered.groupBy("job_id", "start_time", "end_time", "key").agg(F.max("turn").alias("turn"))
    blocks = ranges.selectExpr("job_id", "key", "turn", f"explode({skew.blocks_of('start_time', 'end_time')}) AS b")
    newest = blocks.selectExpr("job_id", "b.level AS level", "b.block AS block", "key", "turn").groupBy("job_id", "level", "block", "key").agg(F.max("turn").alias("turn"))
    times = runs.select("job_id", "scheduled_at").distinct().join(replays.select("job_id").distinct(), "job_id", "left_semi")
    around = times.selectExpr("job_id", "scheduled_at", f"explode({skew.blocks_over('scheduled_at')}) AS b")
    around = around.selectExpr("job_id", "scheduled_at", "b.level AS level", "b.block AS block")
    hits = around.join(newest, ["job_id", "level", "block"])
    won = hits.groupBy("job_id", "scheduled_at", "key").agg(F.max("turn").alias("turn"))
    return won.join(numbered.select("turn", "value").hint("merge"), "turn").select("job_id", "scheduled_at", "key", "value")


def updated_runs(replay_runs: DataFrame, actual: DataFrame) -> DataFrame:
    """Only runs in progress change, and only to success or failed."""
    seen = actual.selectExpr("job_id", "scheduled_at", "state AS seen")
    return replay_runs.join(seen, ["job_id", "scheduled_at"], "left").selectExpr(
        "replay_id", "job_id", "scheduled_at", "IF(state = 'in_progress' AND seen IN ('success', 'failed'), seen, state) AS state"
    )


def _progress(replay_runs: DataFrame) -> DataFrame:
    is_ = lambda s: F.col("state") == s
    return replay_runs.groupBy("replay_id").agg(
        F.count_if(is_("in_progress")).alias("n_in_progress"),
        F.count_if(is_("failed")).alias("n_failed"),
        F.count_if(is_("pending")).alias("n_pending"),
        F.min(F.when(is_("pending"), F.col("scheduled_at"))).alias("first_pending"),
        F.max(F.when(is_("pending"), F.col("scheduled_at"))).alias("last_pending"),
    )


def bounds(replay_runs: DataFrame) -> DataFrame:
    """First and last pending run per replay."""
    return _progress(replay_runs).select("replay_id", "first_pending", "last_pending")


def status(replays: DataFrame, replay_runs: DataFrame) -> DataFrame:
    """Replays whose runs were all sent: still replayed, failed with a count, or success."""
    done = replays.where("status = 'replayed'").select("replay_id").join(_progress(replay_runs), "replay_id", "left")
    return done.selectExpr(
        "replay_id",
        "CASE WHEN n_in_progress > 0 THEN 'replayed' WHEN n_failed > 0 THEN 'failed' ELSE 'success' END AS status",
        "IF(n_in_progress = 0 AND n_failed > 0, concat('runs failed: ', n_failed), '') AS message",
    )


def next_step(replays: DataFrame, replay_runs: DataFrame) -> DataFrame:
    """Sequential replays: the earliest pending run goes when nothing is in progress; a failure does not stop it."""
    going = replays.where("status = 'partial replayed'").select("replay_id").join(_progress(replay_runs), "replay_id", "left")
    going = going.selectExpr("*", "IF(n_in_progress = 0, first_pending, NULL) AS run_now")
    return going.selectExpr(
        "replay_id", "run_now", "IF(coalesce(n_pending, 0) - IF(run_now IS NULL, 0, 1) = 0, 'replayed', 'partial replayed') AS status"
    )


def plan(replays: DataFrame, jobs: DataFrame, actual: DataFrame) -> DataFrame:
    """Runs of each created replay with their first state and logical time, and the replay's new status.

    Runs that never existed start at once. Of the others, all start when parallel, else only the earliest.
    """
    new = replays.where("status = 'created'")
    known = actual.select("job_id", "scheduled_at").distinct().withColumn("known", F.lit(True))
    runs = runs_of(new, jobs).join(known, ["job_id", "scheduled_at"], "left")
    per_replay = runs.groupBy("replay_id").agg(
        F.count("*").alias("n_runs"), F.min(F.when(F.col("known"), F.col("scheduled_at"))).alias("first_known")
    )
    plans = cron.with_plan(jobs.select("job_id", "cron"), "cron").select("job_id", "plan")
    step = runs.join(per_replay, "replay_id").join(new.select("replay_id", "parallel"), "replay_id").join(plans, "job_id")
    return step.selectExpr(
        "replay_id",
        "scheduled_at",
        f"{cron.prev_time('plan', 'scheduled_at')} AS logical_at",
        "known IS NULL AS created",
        "IF(parallel OR known IS NULL OR scheduled_at = first_known, 'in_progress', 'pending') AS state",
        "IF(NOT parallel AND n_runs > 1, 'partial replayed', 'replayed') AS replay_status",
    )


def slots(replays: DataFrame, replay_runs: DataFrame, per_project: int = 10, per_job: int = 5) -> DataFrame:
    """Pending runs that get a slot: first come first served, at most so many per job, then per project.

    Runs in progress hold the slots they have: a job or project has only the rest to give.
    """
    of = replays.select("replay_id", "created_at", *TENANT_JOB)
    running = replay_runs.where("state = 'in_progress'").select("replay_id").join(of, "replay_id")
    by_job = running.groupBy(*TENANT_JOB).agg(F.count("*").alias("job_runs"))
    by_project = by_job.groupBy("project").agg(F.sum("job_runs").alias("project_runs"))
    queue = replay_runs.where("state = 'pending'").select("replay_id", "scheduled_at").join(of, "replay_id")
    order = [F.col("created_at"), F.col("replay_id"), F.col("scheduled_at")]

    def first(rows: DataFrame, keys: list[str], limit: int, held: DataFrame, runs: str) -> DataFrame:
        # At most ``limit`` rows a key pass the shuffle, whatever waits; those held take the last places.
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        ranked = rows.withColumn("__turn", turn).where(F.col("__turn") <= limit)
        return ranked.join(held, keys, "left").where(F.col("__turn") <= limit - F.coalesce(runs, F.lit(0))).drop("__turn", runs)

    return first(first(queue, TENANT_JOB, per_job, by_job, "job_runs"), ["project"], per_project, by_project, "project_runs")


def pick(replays: DataFrame, replay_runs: DataFrame) -> DataFrame:
    """The replay to execute next, most recently updated first, with its runs."""
    one = replays.where("status IN ('created', 'partial replayed', 'replayed')").orderBy(F.desc("updated_at"), "replay_id").limit(1)
    return one.select("replay_id", "status").join(replay_runs.select("replay_id", "scheduled_at", "state"), "replay_id")


def recent(replays: DataFrame, project: str, rows: int = 30) -> DataFrame:
    return replays.where(F.col("project") == project).orderBy(F.desc("created_at"), "replay_id").limit(rows)


def ongoing(replays: DataFrame) -> DataFrame:
    return replays.where(f"status IN ({N.quoted(N.ONGOING_REPLAYS)})")


def timeouts(replays: DataFrame, now: str, hours: int = 3) -> DataFrame:
    """Ongoing replays that are too old, as failed."""
    late = ongoing(replays).where(f"created_at + INTERVAL {hours} HOURS <= {now}")
    return late.selectExpr("replay_id", "'failed' AS status", "'no progress before the deadline' AS message")

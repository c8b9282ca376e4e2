"""Folding run events into run state, operator runs and change events.

Everything is keyed by (project, job_id, scheduled_at) and ordered by (event_time, event_id).
The partial folds are maxima and minima, so they combine before a shuffle, across micro-batches
and across replays of the same batch; streaming/run_state.py keeps the very same partials as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.operators import skew

RUN = ["project", "job_id", "scheduled_at"]
OPERATOR = [*RUN, "operator_type", "operator_name"]
ORDER = ["event_time", "event_id"]

_TYPE = "IF(type RLIKE '^(task|hook|sensor)_', split_part(type, '_', 1), 'job')"
_STATUS = "CASE WHEN type IN ('job_success') OR endswith(type, '_success') THEN 'success' WHEN endswith(type, '_retry') THEN 'retried' ELSE 'failed' END"
_BEGINS = "IF(operator_type = 'sensor', 'wait_upstream', 'in_progress')"


def _order() -> Column:
    return F.struct(*ORDER)


def _is_start() -> Column:
    return F.endswith(F.col("type"), F.lit("_start"))


def _is_job() -> Column:
    return F.col("type").isin("job_success", "failure")


def aimed(events: DataFrame) -> DataFrame:
    """SLA events as one row per run in their list (``slas``), in the event's project; all others as they are.

    Without a list, an SLA event means the run it is keyed by.
    """
    if "slas" not in events.columns:
        return events
    named = next(f.name for f in events.schema["slas"].dataType.elementType.fields if f.name in ("job_id", "job"))
    listed = F.col("type").eqNullSafe("sla_miss") & (F.coalesce(F.size("slas"), F.lit(0)) > 0)
    breaches = events.where(listed).withColumn("__s", F.explode("slas"))
    breaches = breaches.withColumns({"job_id": F.col("__s")[named].cast(events.schema["job_id"].dataType), "scheduled_at": F.col("__s.scheduled_at")})
    return events.where(~listed).unionByName(breaches.drop("__s"))


def keyed(events: DataFrame) -> DataFrame:
    """Events with operator_type (job for events of the run itself) and a name for every operator."""
    typed = events.withColumns({"operator_type": F.expr(_TYPE), "ended_as": F.expr(_STATUS)})
    return typed.withColumn("operator_name", F.when(F.col("operator_type") == "job", "").otherwise(F.coalesce("operator_name", F.lit(""))))


def partial_aggregates() -> list[Column]:
    """Per run and operator: last start, first event, last outcome of the run, SLA flag, latest monitoring values (as JSON)."""
    own = F.col("type") != "sla_miss"
    return [
        F.max(F.when(_is_start(), _order())).alias("last_start"),
        F.min(F.when(own, _order())).alias("first_event"),
        F.max(F.when(_is_job(), F.struct(*ORDER, "ended_as"))).alias("last_outcome"),
        F.max(F.col("type") == "sla_miss").alias("sla_missed"),
        F.max(F.when(F.col("monitoring").isNotNull(), F.struct(*ORDER, F.to_json("monitoring").alias("values")))).alias("monitored"),
    ]


def partials(events: DataFrame) -> DataFrame:
    rows = aimed(events)
    if "monitoring" not in rows.columns:
        rows = rows.withColumn("monitoring", F.lit(None).cast("map<string,string>"))
    return keyed(rows).groupBy(*OPERATOR).agg(*partial_aggregates())


def combine_partials(parts: DataFrame) -> DataFrame:
    """Partials of the same run and operator from several batches as one."""
    return parts.groupBy(*OPERATOR).agg(
        F.max("last_start").alias("last_start"),
        F.min("first_event").alias("first_event"),
        F.max("last_outcome").alias("last_outcome"),
        F.max("sla_missed").alias("sla_missed"),
        F.max("monitored").alias("monitored"),
    )


def run_states(parts: DataFrame) -> DataFrame:
    """State, start, end and SLA flag of every run.

    A start makes the run wait_upstream (sensor) or in_progress. An operator whose first event is an
    outcome is opened by it. The outcome of the run sets state and end time; no outcome means still open.
    An SLA event flags a run but never opens one. ``monitoring`` holds the values that came last.
    """
    begun = F.when(F.col("operator_type") != "job", F.coalesce("last_start", "first_event"))
    changes = parts.select(
        *RUN,
        F.when(begun.isNotNull(), F.struct(begun["event_time"].alias("event_time"), begun["event_id"].alias("event_id"), F.expr(_BEGINS).alias("state"))).alias("c"),
        F.when(
            F.col("last_outcome").isNotNull(),
            F.struct(F.col("last_outcome.event_time"), F.col("last_outcome.event_id"), F.col("last_outcome.ended_as").alias("state")),
        ).alias("o"),
        F.col("first_event.event_time").alias("first_at"),
        "sla_missed",
        "monitored",
    )
    per_run = changes.groupBy(*RUN).agg(
        F.greatest(F.max("c"), F.max("o")).alias("latest"),
        F.max("o").alias("outcome"),
        F.min("first_at").alias("start_time"),
        F.max("sla_missed").alias("sla_alert"),
        F.max("monitored").alias("monitored"),
    )
    return per_run.where("start_time IS NOT NULL").select(
        *RUN,
        F.coalesce(F.col("latest.state"), F.lit("pending")).alias("state"),
        "start_time",
        F.col("outcome.event_time").alias("end_time"),
        "sla_alert",
        F.from_json("monitored.values", "map<string,string>").alias("monitoring"),
    )


def fold_runs(events: DataFrame) -> DataFrame:
    return run_states(partials(events))


def with_sla_definition(states: DataFrame, jobs: DataFrame) -> DataFrame:
    """The SLA of each run's job, in seconds, as the registry has it; NULL where there is none."""
    return skew.join_many_to_one(states, jobs.selectExpr("job_id", "nullif(sla_seconds, 0) AS sla_definition"), ["job_id"], "left")


def operator_runs(events: DataFrame) -> DataFrame:
    """One row per attempt of each operator.

    A start opens an attempt; the last retry, success or failure before the next start closes it.
    Outcomes before any start open one attempt of their own.
    """
    ops = keyed(events).where("operator_type <> 'job'")
    numbered = skew.running_sums(ops, OPERATOR, ORDER, {"attempt": F.when(_is_start(), 1).otherwise(0)})
    ended = F.when(~_is_start(), F.struct(*ORDER, "ended_as"))
    per_attempt = numbered.groupBy(*OPERATOR, "attempt").agg(F.min("event_time").alias("start_time"), F.max(ended).alias("e"))
    return per_attempt.select(
        *OPERATOR,
        "attempt",
        "start_time",
        F.col("e.event_time").alias("end_time"),
        F.coalesce(F.col("e.ended_as"), F.lit("running")).alias("status"),
    )


def latest_operator_runs(attempts: DataFrame) -> DataFrame:
    """The newest attempt of each operator and how often it was started."""
    return attempts.groupBy(*OPERATOR).agg(
        F.max_by(F.struct("start_time", "end_time", "status"), F.col("attempt")).alias("r"), F.max("attempt").alias("starts")
    ).select(*OPERATOR, "r.*", "starts")


def durations(attempts: DataFrame) -> DataFrame:
    """Seconds from start to end per project and operator type: last, mean, median, maximum."""
    seconds = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    done = attempts.where("end_time IS NOT NULL").withColumn("seconds", seconds)
    return done.groupBy("project", "operator_type").agg(
        F.count("*").alias("n"),
        F.sum("seconds").alias("total_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.percentile("seconds", 0.5).alias("median_seconds"),
        F.max_by("seconds", F.struct("end_time", "job_id", "scheduled_at", "operator_name", "attempt")).alias("last_seconds"),
    )


# Values up to 255 have a bucket each; above, 128 equal buckets between any two powers of two.
_EXPONENT = "greatest(length(bin(abs(seconds))) - 8, 0)"
_BUCKET = f"CAST(sign(seconds) AS BIGINT) * ({_EXPONENT} * 128L + shiftright(abs(seconds), {_EXPONENT}))"
JOB_OPERATOR = ["project", "job_id", "operator_type"]


def duration_partials(attempts: DataFrame) -> DataFrame:
    """Durations of ended attempts per job, operator type, day they ended on and bucket of seconds.

    Partials of different attempts can be stored, unioned and merged by ``merge_durations`` in any order. A key has at most
    some 7,000 buckets however many attempts it has (128 for each doubling), and rows are combined before the shuffle.
    """
    done = attempts.where("end_time IS NOT NULL AND start_time IS NOT NULL").withColumn("seconds", F.unix_timestamp("end_time") - F.unix_timestamp("start_time"))
    return done.groupBy(*JOB_OPERATOR, F.date_trunc("DAY", "end_time").alias("day"), F.expr(_BUCKET).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.sum("seconds").alias("total"),
        F.min("seconds").alias("lowest"),
        F.max("seconds").alias("highest"),
        F.max(F.struct("end_time", "scheduled_at", "operator_name", "attempt", "seconds")).alias("last"),
    )


def merge_durations(parts: DataFrame, keys: list[str] = JOB_OPERATOR) -> DataFrame:
    """Partials as one per key and bucket, for instance over all days."""
    return parts.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), F.max("last").alias("last")
    )


def job_durations(parts: DataFrame, keys: list[str] = JOB_OPERATOR, thousandths: tuple[int, ...] = (500, 950)) -> DataFrame:
    """Count, total, mean, longest, last and quantiles of seconds per key; the quantile p is the value at rank ceil(p * n).

    The ends of a bucket are kept, so a quantile is exact where its bucket holds one or two attempts or equal ones, and below 256
    seconds; elsewhere it is too high by less than one part in 128. The last attempt is the one that ended last.
    """
    merged = merge_durations(parts, keys)
    key = Window.partitionBy(*keys)
    counted = merged.withColumns({"up_to": F.sum("n").over(key.orderBy("bucket")), "all": F.sum("n").over(key)})
    quantiles = []
    for p in thousandths:
        rank = f"((all * {p} + 999) DIV 1000)"
        here = f"{rank} > up_to - n AND {rank} <= up_to"
        quantiles.append(F.max(F.expr(f"CASE WHEN {here} THEN IF({rank} = up_to - n + 1, lowest, highest) END")).alias(f"p{p}_seconds"))
    return counted.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("total_seconds"),
        (F.sum("total") / F.sum("n")).alias("mean_seconds"),
        F.max("highest").alias("max_seconds"),
        F.max("last")["seconds"].alias("last_seconds"),
        *quantiles,
    )


def sla_flags(runs: DataFrame, sla_events: DataFrame) -> DataFrame:
    """Runs named in any SLA event's list, within the event's project."""
    missed = sla_events.select("project", F.explode("slas").alias("s")).select("project", "s.job_id", "s.scheduled_at").distinct()
    flagged = runs.select(*RUN).join(missed.withColumn("missed", F.lit(True)), RUN, "left")
    return flagged.select(*RUN, F.coalesce("missed", F.lit(False)).alias("sla_alert"))


def registrations(events: DataFrame) -> DataFrame:
    """Each run registered once, by its first event."""
    return events.groupBy(*RUN).agg(F.min(_order()).alias("first")).select(
        *RUN, F.col("first.event_time").alias("registered_at"), F.col("first.event_id").alias("event_id")
    )


def first_sensor_starts(events: DataFrame) -> DataFrame:
    """Only the first poke of a sensor's attempt: later starts without an outcome in between do not count."""
    sensors = keyed(events).where("operator_type = 'sensor'")
    before = skew.previous_value(sensors, OPERATOR, ORDER, F.col("type"), "before")
    return before.where(_is_start() & (F.col("before").isNull() | ~F.endswith(F.col("before"), F.lit("_start")))).select(*OPERATOR, *ORDER)


def state_changes(events: DataFrame) -> DataFrame:
    """Events that change a run's state, with the new state; repeats of the same state are left out."""
    opening = keyed(events).groupBy(*OPERATOR).agg(F.min(_order()).alias("first")).where("operator_type <> 'job'")
    opening = opening.select(*RUN, F.col("first.event_id").alias("event_id"), F.lit(True).alias("opens")).distinct()
    steps = keyed(events).join(opening, [*RUN, "event_id"], "left").where(_is_job() | _is_start() | F.col("opens"))
    steps = steps.withColumn("state", F.when(_is_job(), F.col("ended_as")).otherwise(F.expr(_BEGINS)))
    changed = skew.previous_value(steps.select(*RUN, *ORDER, "state"), RUN, ORDER, F.col("state"), "before")
    return changed.where("before IS NULL OR before <> state").select(*RUN, *ORDER, "state")


def counters(events: DataFrame) -> DataFrame:
    """How many events of each kind, per project, namespace and operator."""
    kind = F.when(F.col("operator_type") == "job", F.col("type")).otherwise(F.expr("substring(type, length(operator_type) + 2)"))
    return keyed(events).withColumn("event_type", kind).groupBy("project", "namespace", "operator_type", "event_type", "operator_name").agg(
        F.count("*").alias("n")
    )


def status_counters(changes: DataFrame) -> DataFrame:
    return changes.groupBy("job_id", "state").agg(F.count("*").alias("n"))


def windowed_counters(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Events per time window and kind; the same call on a stream with a watermark."""
    return events.groupBy(F.window("event_time", size).alias("w"), "project", "type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "project", "type", "n"
    )

"""Incremental reads: the rows of one run's data window, or the aggregates of many windows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtables import session
from flowtables.functions import cron, windows
from flowtables.operators import skew

# Day, hour, minute, second in microseconds: the possible ticks of window edges.
TICKS = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000)


def bounds_of_run(spark: SparkSession, scheduled_at: str, *, version: int, size: str, offset: str, unit: str) -> tuple[datetime, datetime]:
    """DSTART and DEND of one run as values (one row is computed), to be used as literals in its read."""
    seed = spark.range(1).select(F.lit(scheduled_at).cast("timestamp").alias("scheduled_at"))
    seed = windows.with_settings(seed, f"'{size}'", f"'{offset}'", f"'{unit}'")
    bounds = windows.with_bounds(seed, "scheduled_at", version, "s", "e")
    row = bounds.select(F.col("s").cast("timestamp_ntz"), F.col("e").cast("timestamp_ntz")).first()
    if row is None or row.s is None:
        raise ValueError(f"no data window: version={version} size={size!r} offset={offset!r} truncate_to={unit!r}")
    return row.s, row.e


def read_window(df: DataFrame, ts: str, start: datetime, end: datetime, partition: str | None = None) -> DataFrame:
    """Half-open bounded read. Literals of the column's own type reach the scan; a date partition is pruned too."""
    kind = dict(df.dtypes)[ts]
    lo, hi = F.lit(start.isoformat(sep=" ")).cast(kind), F.lit(end.isoformat(sep=" ")).cast(kind)
    kept = df.where((F.col(ts) >= lo) & (F.col(ts) < hi))
    if partition:
        kept = kept.where(F.col(partition).between(F.lit(start.date()), F.lit(end.date())))
    return kept


def run_windows(
    spark: SparkSession, *, cron_expr: str, start: str, end: str, version: int, size: str, offset: str, unit: str
) -> DataFrame:
    """(scheduled_at, window_start, window_end) of every run of one schedule in a closed range."""
    seed = windows.with_settings(spark.range(1).select(F.lit(cron_expr).alias("expr")), f"'{size}'", f"'{offset}'", f"'{unit}'")
    runs = cron.explode_schedule(seed, "expr", f"'{start}'", f"'{end}'")
    return windows.with_bounds(runs, "scheduled_at", version).drop("expr")


def aggregate_windows(
    df: DataFrame, ts: str, runs: DataFrame, counts: dict[str, Column], sums: dict[str, Column]
) -> DataFrame:
    """Additive aggregates of every run's window, however much the windows overlap.

    Rows are added up per tick, the coarsest unit that divides all window edges (usually an hour or
    a day), with map-side combining, so neither a hot day nor a long overlap multiplies rows. Each
    window is then total(end) - total(start) over the few ticks. Windows without rows are left out.
    """
    runs = session.cut_lineage(runs)
    lo_micros, hi_micros = F.unix_micros("window_start"), F.unix_micros("window_end")
    aligned = [F.bool_and((lo_micros % u == 0) & (hi_micros % u == 0)).alias(f"u{u}") for u in TICKS]
    span = runs.agg(F.min("window_start").alias("lo"), F.max("window_end").alias("hi"), *aligned).first()
    unit = next((u for u in TICKS if span[f"u{u}"]), 1)
    names = {**counts, **sums}

    inside = read_window(df, ts, span.lo or datetime.min, span.hi or datetime.min)
    tick = F.unix_micros(F.col(ts).cast("timestamp"))
    ticks = (
        inside.groupBy((tick - F.pmod(tick, F.lit(unit))).alias("at"))
        .agg(*[F.sum(e).alias(n) for n, e in names.items()])
        .select(F.lit(0).alias("k"), "at", *names)
    )
    # The only pass over the rows; what follows reads the few stored ticks.
    ticks = session.cut_lineage(ticks)
    edges = runs.select(
        "scheduled_at",
        F.explode(
            F.array(
                F.struct(lo_micros.alias("at"), F.lit(-1).alias("sign")),
                F.struct(hi_micros.alias("at"), F.lit(1).alias("sign")),
            )
        ).alias("edge"),
    ).select(F.lit(0).alias("k"), "edge.at", "scheduled_at", "edge.sign", F.lit(False).alias("inclusive"))
    totals = skew.sums_at(ticks, edges, ["k"], "at", list(names))
    result = totals.groupBy("scheduled_at").agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in names])
    return result.where(F.greatest(*[F.col(n) for n in counts], F.lit(0)) > 0)

"""Building blocks that stay distributed when one key holds a large share of all rows.

* ``running_sums`` / ``previous_value`` / ``sums_at`` replace a window over a whole key by windows
  over bins of equal size plus a carry from the earlier bins of the key.
* ``blocks_of`` / ``blocks_over`` turn "which intervals hold this moment" into an equality.
* ``join_many_to_one`` can salt just the keys that are really hot.
* ``first_rows`` relies on Spark's group limit, which trims each key before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtables import session

HOT_ROWS = 2_000_000
SALTS = 32


def _binned(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in bins of about equal size, cut along (keys, order): a hot key or a hot moment fills several bins.

    Stored once, because the cuts come from a sample and both uses of the bins must see the same ones. How many bins
    there are follows from the data: adaptive execution merges small neighbours. ``__key`` is the keys as one value
    that is never NULL, so that windows over it and joins on it share one exchange; NULL keys are keys too.
    """
    spread = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    ranged = df.withColumn("__tie", F.xxhash64(*spread)).repartitionByRange(*keys, *order, "__tie")
    return session.cut_lineage(ranged.withColumn("__bin", F.spark_partition_id())).withColumn("__key", F.struct(*keys))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums per key in the given order."""
    keys = list(keys)
    work = _binned(df.withColumns({f"__v_{n}": e for n, e in sums.items()}), keys, order)
    inside = Window.partitionBy("__key", "__bin").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = work.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)).alias(f"__l_{n}") for n in sums])
    earlier = Window.partitionBy("__key").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        work.groupBy("__key", "__bin")
        .agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
        .select("__key", "__bin", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}") for n in sums])
    )
    return local.join(carry, ["__key", "__bin"]).select(*df.columns, *[(F.col(f"__l_{n}") + F.col(f"__c_{n}")).alias(n) for n in sums])


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, into: str) -> DataFrame:
    """Adds the value of the row before, per key in the given order; NULL on a key's first row."""
    keys = list(keys)
    work = _binned(df.withColumn("__v", F.struct(value.alias("v"))), keys, order)
    inside = Window.partitionBy("__key", "__bin").orderBy(*order, "__tie")
    local = work.select("*", F.lag("__v").over(inside).alias("__p"), F.row_number().over(inside).alias("__n"))
    across = Window.partitionBy("__key").orderBy("__bin")
    carry = (
        work.groupBy("__key", "__bin")
        .agg(F.max_by("__v", F.struct(*order, "__tie")).alias("__last"))
        .select("__key", "__bin", F.lag("__last").over(across).alias("__carry"))
    )
    return local.join(carry, ["__key", "__bin"]).select(
        *df.columns, F.when(F.col("__n") == 1, F.col("__carry")).otherwise(F.col("__p"))["v"].alias(into)
    )


def sums_at(points: DataFrame, probes: DataFrame, keys: Sequence[str], ts: str, sums: Sequence[str], inclusive: str = "inclusive") -> DataFrame:
    """For each probe row, the sums of the points of its key up to the probe's time.

    The boolean probe column ``inclusive`` decides whether points at exactly that time count.
    Probe columns other than the keys and ``ts`` pass through. This replaces a range join: no pairs are made.
    """
    keys = list(keys)
    extra = [c for c in probes.columns if c not in (*keys, ts, inclusive)]
    flat_points = (
        points.groupBy(*keys, ts)
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(*keys, ts, *sums, F.lit(1).alias("__side"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra])
    )
    flat_probes = probes.select(
        *keys,
        ts,
        *[F.lit(0).cast(points.schema[s].dataType).alias(s) for s in sums],
        F.when(F.col(inclusive), F.lit(2)).otherwise(F.lit(0)).alias("__side"),
        *extra,
    )
    summed = running_sums(flat_points.unionByName(flat_probes), keys, [ts, "__side"], {f"__s_{s}": F.col(s) for s in sums})
    return summed.where(F.col("__side") != 1).select(
        *keys, ts, (F.col("__side") == 2).alias(inclusive), *extra, *[F.col(f"__s_{s}").alias(s) for s in sums]
    )


# --- latest interval over a moment --------------------------------------------------

# Blocks of 1, 2, 4 ... 2^22 seconds (about 48 days); longer intervals take several of the largest.
_TOP = 22


def blocks_of(start: str, end: str) -> str:
    """SQL: the aligned blocks (level, block) that exactly cover the whole seconds of [start, end].

    At most two per level, so an interval of any length becomes a few dozen rows instead of one per day.
    """
    state = f"""aggregate(sequence(0, {_TOP - 1}), named_struct('a', CAST(ceil(unix_micros({start}) / 1e6) AS BIGINT), 'b', CAST(floor(unix_micros({end}) / 1e6) AS BIGINT) + 1,
        'out', CAST(array() AS ARRAY<STRUCT<level: INT, block: BIGINT>>)),
        (__s, __k) -> named_struct('a', (__s.a + pmod(__s.a, 2)) DIV 2, 'b', (__s.b - pmod(__s.b, 2)) DIV 2, 'out', concat(__s.out,
            IF(__s.a < __s.b AND pmod(__s.a, 2) = 1, array(named_struct('level', __k, 'block', __s.a)), array()),
            IF(__s.a + pmod(__s.a, 2) < __s.b AND pmod(__s.b, 2) = 1, array(named_struct('level', __k, 'block', __s.b - 1)), array()))),
        __s -> concat(__s.out, IF(__s.a < __s.b, transform(sequence(__s.a, __s.b - 1), __x -> named_struct('level', {_TOP}, 'block', __x)), array())))"""
    return f"IF({start} <= {end}, {state}, CAST(array() AS ARRAY<STRUCT<level: INT, block: BIGINT>>))"


def blocks_over(ts: str) -> str:
    """SQL: all blocks that contain the moment ``ts`` (whole seconds after 1970)."""
    return f"transform(sequence(0, {_TOP}), __k -> named_struct('level', __k, 'block', shiftright(unix_seconds({ts}), __k)))"


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``rows`` rows: a map-side combined count that returns at most total / rows keys.

    Take it from the stored table a join starts from, not from a long plan.
    """
    return df.groupBy(*keys).count().where(F.col("count") > rows).select(*keys, F.lit(True).alias("__hot"))


def join_many_to_one(
    many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner", hot: DataFrame | None = None, salts: int = SALTS
) -> DataFrame:
    """Equi-join whose left side repeats keys.

    Without ``hot`` the plan is left to Spark, which splits skewed partitions at run time (see
    ``session.SETTINGS``). With ``hot`` (see ``hot_keys``) the rows of those keys are spread over
    ``salts`` partitions beforehand and only their right rows are copied.
    """
    keys = list(keys)
    if hot is None:
        return many.join(one, keys, how)
    spread_by = [f.name for f in many.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = many.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    copied = one.join(hot, keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return spread.join(copied, [*keys, "__salt"], how).drop("__salt")


def or_nowhere(column: str, *spread_by: str) -> Column:
    """A string key; NULLs become many values that match nothing, so they do not meet in one task."""
    return F.coalesce(F.col(column), F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*spread_by), F.lit(4096)).cast("string")))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key; the optimizer trims every key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.select("*", rank.alias("__rank")).where(F.col("__rank") <= n).drop("__rank")

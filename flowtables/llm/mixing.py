"""A training mix whose source weights change over time.

Every source has a weight schedule, linear from a start to an end weight over the run; its integral is the source's
weight in the whole mix. Shares follow the weights until a source would be repeated more than ``MOST_REPEATS``
times; what is above is shared again by weight. The documents of a source, in the order of a hash of their ids, form
a stream that starts again when it ends. A document copy that begins after x words of that stream is read at the
time at which the source's integrated schedule has asked for x words; documents are range-sorted by that time.

Running word counts are taken in hash buckets of a source, with the totals of earlier buckets added,
so a source of any size fills many tasks. All sums are whole numbers: reruns agree.

Defined results: a null text has no words; null sources form one source, last in order; null ids count as the
text ''; equal ids and repeated rows follow one another; a source without words is taken once as it is; an
empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables import session
from flowtables.llm.common import WORD, col, pieces, text_or_empty, unpack, whole_row

# (start, end) weights, given to the sources in turn; their means are 5, 2 and 1.
SCHEDULES = ((7.5, 2.5), (2.0, 2.0), (0.5, 1.5))
MOST_REPEATS = 3
ROWS_PER_BUCKET = 50_000
BUCKETS_PER_PIECE = 4


def _in_turn(values: list[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, schedules=SCHEDULES, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Per source (key, source_size): target and the slope of its schedule. One row per source enters.

    Sources are filled in the order of the level at which they reach their bound; the first that stays below its
    bound when all that is left is shared by weight fixes the level for the rest.
    """
    one = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(one.orderBy("key")))
    means = [(a + b) / 2 for a, b in schedules]
    slopes = [(a - b) / (a + b) for a, b in schedules]
    weighted = ranked.withColumns(
        {"weight": _in_turn(means, F.col("rank")), "slope": _in_turn(slopes, F.col("rank")), "bound": F.col("source_size") * most_repeats}
    )
    filling = one.orderBy(F.col("bound") / F.col("weight"), "key")
    left = F.sum("source_size").over(one) - F.coalesce(F.sum("bound").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = weighted.withColumn("left", left).withColumn("among", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    below = F.col("left") * F.col("weight") <= F.col("bound") * F.col("among")
    level = F.min(F.when(below, F.struct((F.col("bound") / F.col("weight")).alias("at"), "key", "left", "among"))).over(one)
    return shared.select("key", "source_size", "slope", "bound", "weight", below.alias("below"), level.alias("level")).select(
        "key", "source_size", "slope",
        F.when(F.col("below"), F.col("level.left") * F.col("weight") / F.col("level.among")).otherwise(F.col("bound").cast("double")).alias("target"),
    )


def _time(asked: Column, slope: Column) -> Column:
    """When a linear schedule, integrated to 1 over [0, 1], has asked for this share."""
    up = 1 + slope
    return F.when(slope == 0, asked).otherwise((up - F.sqrt(F.greatest(F.lit(0.0), up * up - 4 * slope * asked))) / (2 * slope))


def assign(docs: DataFrame, row: Column | None = None, schedules=SCHEDULES, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per document: id, size, source_size, target, copies and the training times of its copies (at most ``most_repeats``)."""
    spark = docs.sparkSession
    buckets = max(BUCKETS_PER_PIECE * pieces(spark), docs.count() // ROWS_PER_BUCKET)
    mixed = F.md5(F.coalesce(col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bucket = F.floor(F.conv(F.substring(mixed, 1, 8), 16, 10).cast("bigint") * buckets / F.lit(float(1 << 32)))
    source = col("source").cast("string")
    rows = docs.select(
        col("doc_id").cast("bigint").alias("id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("key"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size"),
        mixed.alias("mixed"), bucket.alias("bucket"), (F.lit(None).cast("int") if row is None else row).alias("row"),
    )
    if row is None:
        rows = session.cut_lineage(rows)
    totals = session.cut_lineage(rows.groupBy("key", "bucket").agg(F.sum("size").alias("words")))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    plan = targets(totals.groupBy("key").agg(F.sum("words").alias("source_size")), schedules, most_repeats)
    inside = Window.partitionBy("key", "bucket").orderBy("mixed", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(bases.join(plan, "key"), ["key", "bucket"])
    begin = F.col("base") + F.col("upto") - F.col("size")
    whole = F.floor((F.col("target") - begin - F.col("size") / 2) / F.col("source_size")) + 1
    copies = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.least(F.lit(most_repeats), F.greatest(F.lit(0), whole))).cast("int")
    asked = lambda c: F.when(F.col("target") > 0, (c * F.col("source_size") + F.col("begin")) / F.col("target")).otherwise(F.lit(0.0))
    return placed.withColumns({"begin": begin, "copies": copies}).select(
        "id", "size", "source_size", "target", "copies", "mixed", "row",
        F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")),
                    lambda c: _time(asked(c), F.col("slope"))).alias("times"),
    )


def plan_mix(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the time of its first copy (those not taken last): the mix as a table."""
    first = F.get("times", F.lit(0))
    planned = assign(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), first.alias("first_time"), "mixed"
    )
    order = [F.col("first_time").asc_nulls_last(), F.col("mixed")]
    return planned.repartitionByRange(*order).sortWithinPartitions(*order).drop("mixed")


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, repeated as often as taken, range-sorted by training time; columns as given."""
    taken = assign(docs, whole_row(docs)).select("row", "mixed", F.posexplode("times").alias("copy", "time"))
    return unpack(taken.repartitionByRange("time", "mixed").sortWithinPartitions("time", "mixed", "copy"), docs.columns)

"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables import session


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of whole numbers: one row (id, component) per node, component being its smallest node.

    Null ends and loops are ignored.
    """
    moved = merged(edges)
    return moved.unionByName(_own(moved.select("component").distinct()))


def extend(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links (a, b): only links between different components are worked on.

    Ends that ``parts`` does not hold are components of their own. Null ends and loops are ignored.
    """
    moved = merged_further(parts.where("id <> component"), links)
    alone = parts.where("id = component").join(moved.select("id"), "id", "left_anti").select("component")
    return moved.unionByName(_own(moved.select("component").unionByName(alone).distinct()))


def _own(tops: DataFrame) -> DataFrame:
    return tops.select(F.col("component").alias("id"), "component")


def merged(edges: DataFrame) -> DataFrame:
    """Components without the rows of their smallest nodes: (id, component) of every other node, for joins that keep the rest."""
    return _to_stars(session.cut_lineage(_downwards(edges)))


def merged_further(moved: DataFrame, links: DataFrame) -> DataFrame:
    """What ``merged`` returned, after more links (a, b). A node without a row is the smallest of its component, or alone."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    of_a = moved.select(F.col("id").alias("a"), F.col("component").alias("u"))
    of_b = moved.select(F.col("id").alias("b"), F.col("component").alias("v"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b"))
    between = session.cut_lineage(_downwards(ends))
    if between.isEmpty():
        return moved
    wider = _to_stars(between)
    of_top = wider.select(F.col("id").alias("component"), F.col("component").alias("wider"))
    again = moved.join(of_top, "component", "left").select("id", F.coalesce("wider", "component").alias("component"))
    # Links between components join their smallest nodes, which had no row before.
    return session.cut_lineage(again.unionByName(wider))


def _downwards(edges: DataFrame) -> DataFrame:
    """The edges as (u, v) with u > v, each once."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _to_stars(now: DataFrame) -> DataFrame:
    """(id, component) from stored edges (u, v), u > v.

    Each step is two combined minima and two equality joins, stored by a reliable checkpoint; the steps grow with the
    logarithm of a component's length. They end when all edges lead to a smallest node, which is one sum per node and
    not one more step. Only an emptiness test reaches the driver.
    """
    while _unsettled(now):
        both = _rows(now, ("u", "v"), ["u", "v"], ["v", "u"])
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = _rows(large.join(least, "u"), ("u", "v"), ["u", "m"], ["v", "m"])
        now = session.cut_lineage(lower.where("u <> v").distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _rows(df: DataFrame, names: tuple[str, ...], *rows: list) -> DataFrame:
    """Several rows for each one, in a single pass over the table."""
    made = [F.struct(*[(F.col(x) if isinstance(x, str) else x).alias(name) for name, x in zip(names, row, strict=True)]) for row in rows]
    return df.select(F.inline(F.array(*made)))


def _unsettled(now: DataFrame) -> bool:
    """Whether a node has two smaller neighbours, or a smaller and a larger one."""
    ends = _rows(now, ("id", "up", "down"), ["u", F.lit(1), F.lit(0)], ["v", F.lit(0), F.lit(1)])
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 0 AND up + down > 1").isEmpty()

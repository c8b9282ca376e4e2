"""The job graph as an edge table (src, dst): closures, cycles, levels, deletion.

All are loops over small joins. Each step is checkpointed, so the plan stays short and a lost
executor costs one step; only an emptiness test, and tables small enough for ``session.small_broadcasts``,
come back to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables import session
from flowtables.operators import skew


def _loop(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A loop whose many joins collect small tables only."""

    @wraps(fn)
    def run(edges: DataFrame, *args, **options) -> DataFrame:
        with session.small_broadcasts(edges.sparkSession):
            return fn(edges, *args, **options)

    return run


class _Edges:
    """Edges prepared once: stored, and the few sources with very many edges spread over several partitions."""

    def __init__(self, edges: DataFrame, hot_rows: int = skew.HOT_ROWS):
        self.edges = session.cut_lineage(edges.select("src", "dst").distinct())
        hot = session.cut_lineage(skew.hot_keys(self.edges, ["src"], hot_rows))
        self.hot = None if hot.isEmpty() else hot

    def after(self, nodes: DataFrame) -> DataFrame:
        """Edges that leave the given distinct nodes."""
        return skew.join_many_to_one(self.edges, nodes.select(F.col("node").alias("src")), ["src"], hot=self.hot)


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@_loop
def closure(edges: DataFrame, seeds: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(node, depth) of everything reachable from the seeds (``node``), with the least number of steps.

    A seed itself is listed only when an edge leads back to it.
    """
    graph = _Edges(edges, hot_rows)
    frontier, found, depth = session.cut_lineage(seeds.select("node").distinct()), None, 0
    while True:
        depth += 1
        reached = graph.after(frontier).select(F.col("dst").alias("node")).distinct()
        fresh = reached if found is None else reached.join(found, "node", "left_anti")
        frontier = session.cut_lineage(fresh.select("node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            return frontier if found is None else found
        found = frontier if found is None else found.unionByName(frontier)
        if depth % 8 == 0:
            found = session.cut_lineage(found)


@_loop
def levels(edges: DataFrame, nodes: DataFrame | None = None, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(node, level): longest distance from a node without incoming edges; NULL on or behind a cycle.

    Nodes are released level by level as their open incoming edges run out.
    """
    graph = _Edges(edges, hot_rows)
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    every = ends if nodes is None else ends.unionByName(nodes.select("node")).distinct()
    incoming = graph.edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open"))
    state = every.join(incoming, "node", "left").selectExpr(
        "node", "coalesce(open, 0L) AS open", "IF(open IS NULL, 0, NULL) AS level"
    )
    state, level = session.cut_lineage(state), 0
    while True:
        freed = state.where(F.col("level") == level).select("node")
        if freed.isEmpty():
            return state.select("node", "level")
        used = graph.after(freed).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("used"))
        level += 1
        state = session.cut_lineage(
            state.join(used, "node", "left").selectExpr(
                "node",
                "open - coalesce(used, 0L) AS open",
                f"CASE WHEN level IS NOT NULL THEN level WHEN open - coalesce(used, 0L) = 0 THEN {level} END AS level",
            )
        )


class _Steps:
    """Stored steps of a loop that joins its own results: written and read back, since a checkpoint passes on the estimated size of a
    join, which such steps multiply without end. All are deleted when the loop is over."""

    def __init__(self, df: DataFrame):
        self.spark, self.n = df.sparkSession, 0
        self.root = session.scratch(self.spark, "steps")

    def __enter__(self) -> _Steps:
        return self

    def __exit__(self, *error) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def kept(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")


@_loop
def strong_components(edges: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(node, component) of every node on a cycle; the component is its smallest node.

    Ends that lie on no cycle are trimmed first. Then every node learns the smallest node that reaches it; those that reach that
    node back, inside the part with the same label, are its component. Components and edges between parts go, and the rest, if
    any, is labelled again. Nodes between cycles are in no component.
    """
    with _Steps(edges) as steps:
        edges = steps.kept(edges.select("src", "dst").distinct())
        outer = levels(edges, hot_rows=hot_rows).where("level IS NULL").select("node")
        trimmed = steps.kept(_inside(edges, outer))
        core = levels(reverse(trimmed), hot_rows=hot_rows).where("level IS NULL").select("node")
        left, found = steps.kept(_inside(trimmed, core)), None
        while not left.isEmpty():
            labels = _smallest_reaching(left, steps, hot_rows)
            parts = left.join(labels.selectExpr("node AS src", "label"), "src").join(labels.selectExpr("node AS dst", "label"), ["dst", "label"])
            parts = steps.kept(parts.select("src", "dst", "label"))
            roots_ = labels.where("node = label").select("node")
            back = steps.kept(closure(reverse(parts), roots_, hot_rows).select("node").join(labels, "node").selectExpr("node", "label AS component"))
            found = back if found is None else steps.kept(found.unionByName(back))
            gone = back.select("node").unionByName(roots_).distinct()
            rest = parts.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
            left = steps.kept(rest.select("src", "dst"))
        return session.cut_lineage(left.selectExpr("src AS node", "src AS component") if found is None else found)


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")


def _smallest_reaching(edges: DataFrame, steps: _Steps, hot_rows: int) -> DataFrame:
    """(node, label): the smallest node from which each one can be reached, itself included."""
    graph = _Edges(edges, hot_rows)
    labels = steps.kept(graph.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node")))
    fresh = labels
    while True:
        told = graph.after(fresh).join(fresh.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("told"))
        step = steps.kept(labels.join(told, "node", "left").selectExpr("node", "least(label, told) AS label", "coalesce(told < label, false) AS fresh"))
        labels, fresh = step.select("node", "label"), step.where("fresh").select("node", "label")
        if fresh.isEmpty():
            return labels


def cycle_nodes(edges: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Nodes on a cycle."""
    return strong_components(edges, hot_rows).select("node")


@_loop
def cycle_paths(edges: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(component, step, node): a shortest cycle through the smallest node of every component, from that node on.

    Of several ways of the same length, each node comes after its smallest predecessor, and the cycle closes from its smallest last node.
    """
    with _Steps(edges) as steps:
        edges = steps.kept(edges.select("src", "dst").distinct())
        members = steps.kept(strong_components(edges, hot_rows))
        inner = edges.join(members.selectExpr("node AS src", "component"), "src")
        inner = steps.kept(inner.join(members.selectExpr("node AS dst", "component"), ["dst", "component"]))
        graph, depth = _Edges(inner, hot_rows), 0
        frontier = steps.kept(members.where("node = component").selectExpr("node", "0 AS depth", "CAST(NULL AS BIGINT) AS parent"))
        tree = frontier
        while not frontier.isEmpty():
            depth += 1
            reached = graph.after(frontier).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
            frontier = steps.kept(reached.join(tree, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
            tree = tree.unionByName(frontier) if depth % 8 else steps.kept(tree.unionByName(frontier))
        tree = steps.kept(tree.join(members, "node"))
        closing = tree.join(inner.where("dst = component").selectExpr("src AS node"), "node", "left_semi")
        at = steps.kept(closing.groupBy("component").agg(F.min(F.struct("depth", "node", "parent")).alias("l")).select("component", "l.*"))
        path = at
        while not at.where("depth > 0").isEmpty():
            before = at.where("depth > 0").selectExpr("component", "parent AS node")
            at = steps.kept(before.join(tree, ["component", "node"]).select("component", "depth", "node", "parent"))
            path = path.unionByName(at)
        return session.cut_lineage(path.selectExpr("component", "depth AS step", "node"))


def roots(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without an upstream."""
    return nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def delete_blockers(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """Downstreams of the nodes to delete that are not deleted with them; empty means safe."""
    return closure(edges, doomed).join(doomed.select("node"), "node", "left_anti")


def delete_order(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """(node, step, error): everything downstream of the given nodes and they themselves, deepest first, each once.

    Nodes on or behind a cycle have no order: their step is NULL and ``error`` says why.
    """
    gone = session.cut_lineage(closure(edges, doomed).select("node").unionByName(doomed.select("node")).distinct())
    inner = edges.join(gone.withColumnRenamed("node", "src"), "src", "left_semi").join(gone.withColumnRenamed("node", "dst"), "dst", "left_semi")
    depth = levels(inner, gone)
    deepest = depth.agg(F.max("level")).first()[0] or 0
    error = F.when(F.col("level").isNull(), "on or behind a cycle")
    return depth.select("node", (F.lit(deepest) - F.col("level")).alias("step"), error.alias("error"))

"""The trie of conversation prefixes, by a splitter skeleton.

A conversation is the sequence of its turns; conversations that begin with the same d turns share a node of depth d. Turns are
known by the first 16 bytes of a SHA-256 over role and text, so texts are read once and never shuffled.

1. Conversations are range-partitioned and sorted by (turns, conv_id). The members of a node lie next to each other, and the id in the order
   lets copies of one conversation fill as many shards as they need.
2. Only a node whose members lie on both sides of a border between shards is unfinished in a shard. Such nodes are the prefixes that the
   last conversation before a border shares with the first one behind it; their trie, the skeleton, is broadcast. It has at most
   ``MOST_SKELETON`` nodes; where borders share more, there are half as many shards, down to one.
3. Every shard is read once in order, with one open node per depth. All other nodes are finished there. Skeleton nodes
   leave partial aggregates, which are reduced by key and then added up along the skeleton.
4. The members that end in a node come out in order of their ids. The digest over them is a single pass by definition: those of a skeleton
   node are streamed through it in chunks, whatever their number.

Defined results: rows without conv_id are ignored; turns are ordered by (turn, digest), null first, so equal turn numbers keep all
their rows in a fixed order; null role or text is empty; a repeated row is one more turn; an empty table has no node, not even
a root; other columns are never read. The digests of one conversation (20 bytes a turn) are held in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtables import session
from flowtables.llm.common import WORD, col

MOST_SKELETON = 1 << 20
CHUNK_BYTES = 1 << 16
_BATCH = 4096

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def paths(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id and turns, an array of (turn, key, words) in order."""
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length tells where the role ends.
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    turns = conversations.select(col("conv_id").cast("bigint").alias("conv_id"), F.struct(col("turn").alias("turn"), key.alias("key"), words.alias("words")).alias("t"))
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuild(given: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first h turns taken from the one at conv_id - conv_id % every, where h = crc32(conv_id) % most."""
    base = given.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = given.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", F.array().cast(given.schema["turns"].dataType)), F.lit(1), F.col("h")))
    joined = own.join(base, "base", "left")
    return joined.select("conv_id", F.when(F.col("h") > 0, F.concat(head, rest)).otherwise(F.col("turns")).alias("turns"))


def _sharded(sequences: DataFrame, shards: int | None) -> DataFrame:
    flat = sequences.select("conv_id", F.col("turns.key").alias("path"), F.col("turns.words").alias("words"))
    by = [F.col("path"), F.col("conv_id")]
    ranged = flat.repartitionByRange(shards, *by) if shards else flat.repartitionByRange(*by)
    return session.cut_lineage(ranged.sortWithinPartitions("path", "conv_id").withColumn("shard", F.spark_partition_id()))


def _shared_prefixes(sharded: DataFrame) -> DataFrame:
    """What the last path before each border and the first one behind it have in common: (path, words), at most one row per border."""
    this = F.struct("path", "conv_id", "words")
    ends = sharded.groupBy("shard").agg(F.min(this).alias("first"), F.max(this).alias("last"))
    # One row per shard.
    beside = ends.select("first", F.lag("last").over(Window.orderBy("shard")).alias("before")).where(F.col("before").isNotNull())
    same = F.zip_with("before.path", "first.path", lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.when(F.forall(same, lambda x: x), F.size(same)).otherwise(F.array_position(same, False) - 1).cast("int")
    cut = beside.withColumn("n", shared).where(F.col("n") > 0)
    return cut.select(F.slice("first.path", F.lit(1), F.col("n")).alias("path"), F.slice("first.words", F.lit(1), F.col("n")).alias("words"), "n").distinct()


class Skeleton:
    """The trie of shared prefixes: node 0 is the root, parents come before children."""

    def __init__(self, prefixes: list[tuple[list[bytes], list[int]]]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.words = [-1], [0], [0]
        for path, words in prefixes:
            at = 0
            for key, n in zip(path, words, strict=True):
                if (at, key) not in self.child:
                    self.child[at, key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                    self.words.append(n)
                at = self.child[at, key]


def _shards_and_skeleton(sequences: DataFrame) -> tuple[DataFrame, Skeleton]:
    shards = None
    while True:
        sharded = _sharded(sequences, shards)
        shared = session.cut_lineage(_shared_prefixes(sharded))
        if (shared.agg(F.sum("n")).first()[0] or 0) <= MOST_SKELETON:
            return sharded, Skeleton([(r.path, r.words) for r in shared.collect()])
        shards = max(1, (shards or sharded.agg(F.count_distinct("shard")).first()[0]) // 2)


class _Open:
    """A node whose members are still coming."""

    __slots__ = ("key", "words", "skeleton", "least", "n", "children", "leaves", "saved", "ends", "ended", "held")

    def __init__(self, key: bytes | None, words: int, skeleton: int | None):
        self.key, self.words, self.skeleton = key, words, skeleton
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.ended, self.held = hashlib.sha256() if skeleton is None else [], False, []


# kind 0: a finished node; 1: the part of a skeleton node; 2: ids that end in a skeleton node.
PART = pa.schema(
    [("kind", pa.int32()), ("skeleton", pa.int64()), ("shard", pa.int64()), ("at", pa.int64())]
    + [(n, pa.int64()) for n in NODE[:-1]] + [("ends_sha256", pa.string()), ("ids", pa.string())]
)
_PART_SQL = "kind int, skeleton long, shard long, at long, " + ", ".join(f"{n} long" for n in NODE[:-1]) + ", ends_sha256 string, ids string"


class _Shard:
    """Reads one shard's conversations in order and puts rows of ``PART`` into ``out``."""

    def __init__(self, shard: int, skeleton: Skeleton, out: list[tuple]):
        self.shard, self.skeleton, self.out, self.chunks = shard, skeleton, out, 0
        self.stack = [_Open(None, 0, 0)]

    def add(self, conv_id: int, path: list[bytes], words: list[int]) -> None:
        stack, same = self.stack, 0
        while same < len(path) and same + 1 < len(stack) and stack[same + 1].key == path[same]:
            same += 1
        while len(stack) > same + 1:
            self._close()
        for k in range(same, len(path)):
            above = stack[-1].skeleton
            stack.append(_Open(path[k], words[k], None if above is None else self.skeleton.child.get((above, path[k]))))
        for node in stack:
            node.n += 1
            if node.least is None or conv_id < node.least:
                node.least = conv_id
        end = stack[-1]
        if end.skeleton is None:
            end.ends.update(f",{conv_id}".encode() if end.ended else str(conv_id).encode())
        else:
            end.ends.append(str(conv_id))
            if len(end.ends) * 8 > CHUNK_BYTES:
                self._chunk(end)
        end.ended = True

    def _chunk(self, node: _Open) -> None:
        if node.ends:
            self.out.append((2, node.skeleton, self.shard, self.chunks, *[None] * 8, ",".join(node.ends)))
            self.chunks += 1
            node.ends = []

    def _close(self) -> None:
        node = self.stack.pop()
        depth, above = len(self.stack), self.stack[-1] if self.stack else None
        if node.skeleton is not None:
            # Its own words count once per node and not per shard, and whether it is a leaf is known later.
            self._chunk(node)
            self.out.append((1, node.skeleton, None, None, node.least, depth, None, node.n, node.children, node.leaves, node.saved + node.n * node.words, None, None))
            if above is not None:
                above.leaves += node.leaves
                above.saved += node.saved + node.n * node.words
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.words
        # The smallest member of the parent is known when the parent is; children of skeleton nodes learn it after the reduction.
        for child in node.held:
            self.out.append((*child[:6], node.least, *child[7:]))
        row = (0, above.skeleton, None, None, node.least, depth, None, node.n, node.children, leaves, saved, node.ends.hexdigest(), None)
        if above.skeleton is None:
            above.held.append(row)
        else:
            self.out.append(row)
        above.children += 1
        above.leaves += leaves
        above.saved += saved

    def finish(self) -> None:
        while self.stack:
            self._close()


def _read_shards(sharded: DataFrame, skeleton: Skeleton) -> DataFrame:
    shared = sharded.sparkSession.sparkContext.broadcast(skeleton)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PART)], schema=PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        open_shard: _Shard | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for shard, conv_id, path, words in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if open_shard is None or open_shard.shard != shard:
                        if open_shard is not None:
                            open_shard.finish()
                        open_shard = _Shard(shard, shared.value, out)
                    open_shard.add(conv_id, path, words)
                if len(out) >= _BATCH:
                    yield batch_of(out)
                    out.clear()
        if open_shard is not None:
            open_shard.finish()
        for at in range(0, len(out), _BATCH):
            yield batch_of(out[at : at + _BATCH])

    ordered = sharded.select("shard", "conv_id", "path", "words").sortWithinPartitions("shard", "path", "conv_id")
    return ordered.mapInArrow(run, _PART_SQL)


def _ends(parts: DataFrame) -> DataFrame:
    """(skeleton, ends_sha256): ids of each skeleton node streamed through its digest in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for skeleton, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if skeleton != node:
                    if digest is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = skeleton, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["skeleton", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["skeleton", "ends_sha256"])

    chunks = parts.where("kind = 2").select("skeleton", "ids", "shard", "at").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "at")
    return chunks.select("skeleton", "ids").mapInArrow(run, "skeleton long, ends_sha256 string")


def _along_skeleton(reduced: list, skeleton: Skeleton) -> list[tuple]:
    """Rows of the skeleton nodes, from the reduced parts: children, leaves and words of the skeleton itself are added bottom up."""
    by_node = {r.skeleton: r for r in reduced}
    size = len(skeleton.parent)
    kids, leaves, words = [0] * size, [0] * size, list(skeleton.words)
    for k in reversed(range(size)):
        if not kids[k] and not by_node[k].n_children:
            leaves[k] = 1
        if k:
            above = skeleton.parent[k]
            kids[above] += 1
            leaves[above] += leaves[k]
            words[above] += words[k]
    return [
        (k, r.conv_id, skeleton.depth[k], by_node[skeleton.parent[k]].conv_id if k else None, r.n_convs, r.n_children + kids[k], r.n_leaves + leaves[k], r.saved_tokens - words[k])
        for k, r in sorted(by_node.items())
    ]


def trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, turns): the columns of ``NODE``."""
    spark = sequences.sparkSession
    sharded, skeleton = _shards_and_skeleton(sequences)
    parts = session.cut_lineage(_read_shards(sharded, skeleton))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    # At most one row per skeleton node reaches the driver.
    reduced = parts.where("kind = 1").groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *sums).collect()
    rows = _along_skeleton(reduced, skeleton) if reduced else []
    schema = "skeleton long, " + ", ".join(f"{n} long" for n in NODE[:-1])
    nodes = spark.createDataFrame(rows, schema)
    ended = nodes.join(_ends(parts), "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    above = nodes.select("skeleton", F.col("conv_id").alias("of_skeleton"))
    local = parts.where("kind = 0").join(above, "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_skeleton"))
    return local.select(NODE).unionByName(ended.select(NODE))


def rebuilt_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of the conversations after ``rebuild``."""
    return trie(rebuild(session.cut_lineage(paths(conversations)), every, most))

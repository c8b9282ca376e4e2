"""Near duplicates by min-max hashing, confirmed on full shingle sets.

Under each permutation both the smallest and the largest value of a document's shingles are kept, so
``PERMUTATIONS`` hash evaluations give twice as many signature values, each of which agrees for two documents with the
probability of their similarity. ``BANDS`` bands of ``ROWS`` values each make buckets: a pair of similarity 0.8 shares none
with a probability of (1 - 0.8^4)^24 = 3e-6, a closer pair with less.

Order of work, without listing all pairs of a bucket:
1. documents with equal sets form a class, whose smallest id stands for it;
2. in every bucket all members are compared in full with one centre, the member that shares most bucket places
   (of a base and its edited copies: the base); confirmed pairs give components;
3. members of a bucket's smaller components are compared in full with the member of another component whose signature
   agrees most with theirs;
4. where components of one bucket still differ, the smaller ones meet all others with their full sets, in blocks of bounded
   size inside tasks. Only links come out, so nothing grows with the pairs of a group. Pairs whose signatures agree in less than
   ``LEAST_ESTIMATE`` (nearly five standard deviations below 0.8) are passed over. No partner is capped: every other
   pair of a bucket is then in one component or was compared.

Defined results: null and empty texts have an empty set and are linked with nothing; rows without an id are not
linked, have no component and are kept; rows with the same id are one node with the links of each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables import session
from flowtables.llm.common import col, stored, text_or_empty, unpack, whole_row
from flowtables.llm.components import merged, merged_further
from flowtables.llm.hashing import mix, shingles, word_hashes

PERMUTATIONS, BANDS, ROWS = 48, 24, 4
LEAST_ESTIMATE = 0.6
BLOCK = 1 << 20
MEMBERS_PER_TASK_GROUP = 256
SALTS = 32
# A shingle travels as 5 bytes of its hash.
SHINGLE_BYTES = 5
_BATCH = 512

_draw = np.random.default_rng(20240131)
_SCALE = (_draw.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFT = _draw.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest and largest value under each permutation, one after the other: 2 * PERMUTATIONS values."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    narrow = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(narrow), 1 << 14):
        values = np.multiply.outer(_SCALE, narrow[at : at + (1 << 14)])
        values += _SHIFT[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, which also says which band it is."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.astype(np.int64)


def _in_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            part = batch.slice(at, _BATCH)
            yield part.column(0), [x.as_py() for x in part.column(1).cast(pa.binary())]


SIGNED = pa.schema(
    [("id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("keys", pa.list_(pa.int64())), ("short", pa.binary())]
)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """Per row: id, n (shingles), same (digest of the set), keys (one per band), short (8 bits of each signature value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for ids, texts in _in_batches(batches):
            n, same, keys, short = [], [], [], []
            for hashes in map(lambda w: shingles(w, words), word_hashes(texts)):
                sig = signature(hashes)
                n.append(len(hashes))
                same.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                keys.append(bands(sig) if len(hashes) else [])
                short.append((sig >> np.uint32(12)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, f.type) for x, f in zip((n, same, keys, short), list(SIGNED)[1:], strict=True)]], schema=SIGNED)

    picked = docs.select(col("doc_id").cast("bigint").alias("id"), text_or_empty().alias("text"))
    return picked.mapInArrow(run, "id long, n long, same binary, keys array<long>, short binary")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, items) of the wanted ids: sorted shingle hashes, 5 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _in_batches(batches):
            items = [packed(shingles(w, words)) for w in word_hashes(texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(items, pa.binary())], names=["id", "items"])

    picked = docs.select(col("doc_id").cast("bigint").alias("id"), text_or_empty().alias("text"))
    return picked.join(wanted, "id", "left_semi").mapInArrow(run, "id long, items binary")


def packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHINGLE_BYTES].tobytes()


def unpacked(items: bytes) -> np.ndarray:
    wide = np.zeros((len(items) // SHINGLE_BYTES, 8), np.uint8)
    wide[:, :SHINGLE_BYTES] = np.frombuffer(items, np.uint8).reshape(-1, SHINGLE_BYTES)
    return wide.view("<u8").ravel()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct values."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    if not len(y) or percent * len(x) > 100 * len(y):
        return False
    both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union.

    Sets meet in groups of one b and at most about ``MEMBERS_PER_TASK_GROUP`` a, so a busy b is spread. Only a b with several
    groups must learn how many it has; its pairs are salted for that.
    """
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK_GROUP).cast("int").alias("groups"))
    busy = groups.where("groups > 1").select("b", "groups", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a", F.lit(1)), F.lit(SALTS)).cast("int").alias("salt"))
    group = F.coalesce(F.pmod(F.xxhash64("a"), F.col("groups")).cast("int"), F.lit(0))
    spread = salted.join(busy, ["b", "salt"], "left").select("b", group.alias("g"), F.col("a").alias("id"))
    heads = groups.select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.col("b").alias("id"))
    asked = heads.withColumn("head", F.lit(True)).unionByName(spread.withColumn("head", F.lit(False)))
    rows = asked.join(sets, "id").select("b", "g", "head", "id", "items").repartition("b", "g").sortWithinPartitions("b", "g", F.desc("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centres = None, []
        for batch in batches:
            a, b = [], []
            for at_b, g, head, at_a, items in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if group != (at_b, g):
                    group, centres = (at_b, g), []
                mine = unpacked(items)
                if head:
                    centres.append(np.sort(mine))
                    continue
                if any(_similar(centre, np.sort(mine), percent) for centre in centres):
                    a.append(at_a)
                    b.append(at_b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


MEETING = ("key", "s", "t", "block", "id", "component", "n")


def _meetings(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Blocks of a bucket's members that must meet because components differ: columns ``MEETING``.

    A bucket's largest component is its main one. Odd members, those of other components, meet each other and the main
    ones; main ones do not meet each other. A block holds about ``BLOCK`` shingles, whatever the bucket's size.
    """
    placed = members.join(parts, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    weight = F.sum(F.col("n") + BLOCK // 1024)
    kinds = placed.groupBy("key", "component").agg(F.count("*").alias("count"), weight.alias("weight"))
    buckets = kinds.groupBy("key").agg(F.sum("count").alias("size"), F.sum("weight").alias("weight"), F.max(F.struct("count", "component", "weight")).alias("main"))
    # Two members of a bucket have been compared already.
    buckets = buckets.where((F.col("size") > 2) & (F.col("size") > F.col("main.count"))).select(
        "key", F.col("main.component").alias("main"),
        F.ceil((F.col("weight") - F.col("main.weight")) / BLOCK).cast("int").alias("odd_blocks"), F.ceil(F.col("main.weight") / BLOCK).cast("int").alias("main_blocks"),
    )
    salt = F.xxhash64("id")
    blocked = placed.join(buckets, "key").select(
        "key", "id", "component", "n", "odd_blocks", (F.col("odd_blocks") + F.col("main_blocks")).alias("blocks"),
        F.when(F.col("component") != F.col("main"), F.pmod(salt, F.col("odd_blocks"))).otherwise(F.col("odd_blocks") + F.pmod(salt, F.col("main_blocks"))).cast("int").alias("block"),
    )
    # A block of odd members meets itself and every later block.
    as_left = F.when(F.col("block") < F.col("odd_blocks"), F.transform(F.sequence("block", F.col("blocks") - 1), lambda x: F.struct(F.col("block").alias("s"), x.alias("t"))))
    as_right = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("odd_blocks") - 1), lambda x: x < F.col("block")), lambda x: F.struct(x.alias("s"), F.col("block").alias("t"))
    )
    none = F.array().cast("array<struct<s:int,t:int>>")
    meetings = blocked.select("key", "id", "component", "n", "block", F.explode(F.concat(F.coalesce(as_left, none), as_right)).alias("m"))
    return meetings.select("key", "m.s", "m.t", "block", "id", "component", "n")


def _by_meeting(rows: DataFrame, compare) -> DataFrame:
    """The pairs (a, b) that ``compare`` yields from the rows of each meeting."""
    rows = rows.repartition("key", "s", "t").sortWithinPartitions("key", "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[0][:3] != row[:3]:
                    found.extend(compare(held))
                    held = []
                held.append(row)
            yield out(found)
        if held:
            yield out(list(compare(held)))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _likely(rows: list[tuple], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each odd row of a meeting: its index, the rows that may be similar to it and their estimates."""
    _, s, t, *_ = rows[0]
    block, component, n = (np.array([r[k] for r in rows]) for k in (3, 5, 6))
    short = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), -1)
    right = np.flatnonzero(block == t)
    for i in np.flatnonzero(block == s):
        others = right[right > i] if s == t else right
        others = others[(component[others] != component[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
        if len(others):
            estimate = (short[others] == short[i]).mean(axis=1)
            close = estimate >= LEAST_ESTIMATE
            if close.any():
                yield i, others[close], estimate[close]


def _nearest(members: DataFrame, parts: DataFrame, shorts: DataFrame, percent: int) -> DataFrame:
    """For each odd member and block, the one member of another component that looks most similar."""

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        for i, others, estimate in _likely(rows, percent):
            a, b = rows[i][4], rows[others[estimate.argmax()]][4]
            if a != b:
                yield max(a, b), min(a, b)

    rows = _meetings(members, parts).join(shorts, "id").select(*MEETING, "short")
    return _by_meeting(rows, compare)


def _links_apart(members: DataFrame, parts: DataFrame, shorts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links still missing between components, found inside the meetings by full sets; no failing pair comes out.

    A pair that shares several buckets is compared in the first of them only; members that a link of the same meeting
    has just joined are not compared again.
    """

    def compare(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        key, up, opened = rows[0][0], {}, {}
        keys = np.array([r[8] for r in rows], np.int64)

        def top(x: int) -> int:
            while up.get(x, x) != x:
                x = up[x]
            return x

        def items(k: int) -> np.ndarray:
            if k not in opened:
                opened[k] = np.sort(unpacked(rows[k][9]))
            return opened[k]

        for i, others, estimate in _likely(rows, percent):
            same = keys[others] == keys[i]
            first = keys[i][same.argmax(axis=1)] == key
            for j in others[first][np.argsort(-estimate[first], kind="stable")]:
                a, b = top(rows[i][5]), top(rows[j][5])
                if a != b and _similar(items(i), items(j), percent):
                    up[max(a, b)] = min(a, b)
                    yield rows[i][4], rows[j][4]

    rows = _meetings(members, parts).join(shorts.join(sets, "id"), "id").select(*MEETING, "short", "keys", "items")
    return _by_meeting(rows, compare)


def find_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Words per shingle and percent of similarity are parameters."""
    spark = docs.sparkSession
    rows = stored(signed(docs, words), "near-signed")
    sets_of = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = session.cut_lineage(sets_of.groupBy("same", "n").agg(F.min("id").alias("rep")))
    # The smallest row of a class stands for it; ids that occur with several sets connect their classes.
    named = sets_of.select("id", "same", "n").join(classes, ["same", "n"])
    several = named.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where(F.col("b") != F.col("top")).select("id", "b")
    by_id = named.select("id", F.col("rep").alias("a")).join(several, "id").select("a", "b").distinct()
    reps = sets_of.join(classes.select("same", "n", F.col("rep").alias("id")), ["same", "n", "id"], "left_semi")
    places = reps.select("id", "n", F.explode("keys").alias("key"))
    shared = places.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    members = session.cut_lineage(places.join(shared, "key").distinct())
    busy = members.groupBy("id").agg(F.sum("size").alias("busy"))
    centres = members.join(busy, "id").groupBy("key").agg(F.max(F.struct("busy", (-F.col("id")).alias("least"))).alias("c"))
    pairs = members.join(centres, "key").select(F.col("id").alias("a"), (-F.col("c.least")).alias("b")).where(F.col("a") != F.col("b")).distinct()
    pairs = session.cut_lineage(pairs)
    members = members.select("key", "id", "n")
    sets = stored(_sets(docs, members.select("id").distinct(), words), "near-sets")
    links = session.cut_lineage(_confirmed(pairs, sets, percent))
    # Both searches between components look signatures up: found and stored once, about 300 bytes each.
    shorts = session.cut_lineage(reps.join(members.select("id").distinct(), "id", "left_semi").select("id", "short", "keys"))
    parts = merged(links)
    near = session.cut_lineage(_nearest(members, parts, shorts.drop("keys"), percent))
    parts = merged_further(parts, session.cut_lineage(_confirmed(near, sets, percent)))
    rest = session.cut_lineage(_links_apart(members, parts, shorts, sets, percent).unionByName(by_id))
    final = merged_further(parts, rest)
    of_class = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("same", "n", F.coalesce("component", "rep").alias("component"))
    return rows.join(of_class, ["same", "n"], "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one id of each component, all columns kept; rows that repeat that id stay (see ``exact_dedup``)."""
    gone = find_near_copies(docs, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(col("doc_id").cast("bigint").alias("id"), whole_row(docs).alias("row"))
    return unpack(rows.join(gone, "id", "left_anti"), docs.columns)

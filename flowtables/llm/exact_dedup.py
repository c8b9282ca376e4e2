"""Exact duplicates by a content sort.

Sampled splitters cut the order (leading bytes, digest, id) of the normalised texts into bins of about equal
size; each bin is sorted outside memory, equal texts come to stand next to each other, and every row is compared
in full with its neighbour. The id is part of the order, so copies of one text fill as many bins as they need:
no group has to fit anywhere. Runs that go on over a border between bins are joined by the full texts at the
two ends of each bin. The texts are shuffled once.

Defined results: a null text is the empty text; white space runs count as one space (no trimming); null ids
come after all others; of several rows with the same text and the same smallest id exactly one is kept;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables import session
from flowtables.llm.common import SPACES, col, pieces, stored, text_or_empty, unpack, whole_row

LEADING_BYTES = 16
BIN_BYTES = 64 << 20
BINS_PER_PIECE = 4
ROWS_PER_BIN = 16
SAMPLE_PER_BIN = 32
MOST_BINS = 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def _place(norm: Column, sha: Column, doc_id: Column) -> Column:
    """Sort key of fixed width: leading bytes of the text, its digest, its id; as bytes it sorts as its parts do.

    Texts that share their leading bytes are told apart by the digest, so a splitter stays short whatever the texts.
    """
    head = F.rpad(F.hex(F.substring(norm.cast("binary"), 1, LEADING_BYTES)), 2 * LEADING_BYTES, ".")
    shifted = doc_id.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.concat(head, sha, F.coalesce(F.lpad(shifted.cast("string"), 20, "0"), F.lit("~")))


def _splitters(keyed: DataFrame) -> list[str]:
    """Keys between bins, from a bounded sample; the number of rows comes from file footers where it can."""
    rows = keyed.count()
    if rows == 0:
        return []
    wanted = min(MOST_BINS, BINS_PER_PIECE * pieces(keyed.sparkSession)) * SAMPLE_PER_BIN
    sample = keyed.sample(fraction=min(1.0, wanted / rows), seed=7) if rows > wanted else keyed
    sampled = sample.select(_place(F.col("norm"), F.sha2(F.col("norm"), 256), F.col("id")).alias("key"), F.octet_length("norm").alias("bytes"))
    taken = sampled.collect()
    if not taken:
        return []
    total = sum(r["bytes"] for r in taken) / len(taken) * rows
    bins = max(total / BIN_BYTES, min(rows / ROWS_PER_BIN, BINS_PER_PIECE * pieces(keyed.sparkSession)))
    bins = int(min(MOST_BINS, len(taken), max(1, bins)))
    keys = sorted(r["key"] for r in taken)
    return sorted({keys[len(keys) * k // bins] for k in range(1, bins)})


def _bin(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or before the key, by halving: about log2(n) comparisons a row."""
    if not splitters:
        return F.lit(0)
    array = F.split(F.lit(",".join(splitters)), ",")
    steps = [1 << k for k in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.lit(steps).cast("array<int>"),
        F.lit(0),
        lambda low, step: F.when((low + step <= len(splitters)) & (F.get(array, low + step - 1) <= key), low + step).otherwise(low),
    )


def sorted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document with its run of equal texts.

    Columns: id, keep_id, group_size, kept, sha. With ``carry`` only the kept rows, with all columns in ``row``.
    """
    picked = [col(id_col).cast("bigint").alias("id"), normalised(text_or_empty(text_col)).alias("norm")]
    splitters = _splitters(docs.select(*picked))
    # The stored text travels where the whole row is wanted; the normalised one is made again behind the shuffle.
    given = whole_row(docs) if carry else F.lit(None).cast("int")
    sha = F.sha2(F.col("norm"), 256)
    keyed = docs.select(*picked, given.alias("row")).withColumn("sha", sha).withColumn("key", _place(F.col("norm"), F.col("sha"), F.col("id")))
    binned = keyed.withColumn("bin", _bin(F.col("key"), splitters))
    if carry:
        binned = binned.drop("norm").repartition("bin").withColumn("norm", normalised(F.coalesce(F.col("row")[text_col], F.lit(""))))
    in_bin = Window.partitionBy("bin").orderBy("key")
    compared = binned.select(
        "bin", "id", "row", "sha", "norm",
        F.row_number().over(in_bin).alias("at"),
        F.lag("norm").over(in_bin).alias("before"),
        F.lead("bin").over(in_bin).isNull().alias("last"),
    )
    starts = F.col("before").isNull() | (F.col("before") != F.col("norm"))
    edge = (F.col("at") == 1) | F.col("last")
    marked = compared.select(
        "bin", "id", "sha", "at", starts.alias("starts"),
        F.when(starts, F.col("row")).alias("row"),
        F.when(edge, F.col("norm")).alias("edge"),
    )
    so_far = Window.partitionBy("bin").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = marked.withColumn("head", F.max(F.when(F.col("starts"), F.col("at"))).over(so_far))
    if carry:
        kept = stored(headed.where(F.col("starts") | F.col("edge").isNotNull()).select("bin", "at", "head", "starts", "edge", "row"), "content-sort")
        first = _first_bins(kept)
        found = kept.where("starts").join(first, ["bin", "head"], "left")
        return found.where(F.col("first_bin").isNull() | (F.col("first_bin") == F.col("bin"))).select("row")
    kept = session.cut_lineage(headed.select("bin", "id", "sha", "at", "head", "edge"))
    in_run = Window.partitionBy("bin", "head")
    local = kept.select("*", F.count("*").over(in_run).alias("local_size"), F.min("id").over(in_run).alias("local_id"))
    whole = _whole_runs(local)
    return local.join(whole, ["bin", "head"], "left").select(
        "id",
        F.coalesce(F.col("keep_id"), F.col("local_id")).alias("keep_id"),
        F.coalesce(F.col("size"), F.col("local_size")).alias("group_size"),
        ((F.col("at") == F.col("head")) & (F.coalesce(F.col("first_bin"), F.col("bin")) == F.col("bin"))).alias("kept"),
        "sha",
    )


def _first_bins(rows: DataFrame) -> DataFrame:
    """For the runs at the ends of bins: the bin in which their text begins. At most two rows a bin."""
    ends = rows.where(F.col("edge").isNotNull()).groupBy("bin", "head").agg(F.first("edge").alias("edge"))
    texts = ends.groupBy("edge").agg(F.min("bin").alias("first_bin"))
    return ends.join(texts, "edge").select("bin", "head", "first_bin")


def _whole_runs(rows: DataFrame) -> DataFrame:
    ends = rows.where(F.col("edge").isNotNull()).groupBy("bin", "head").agg(
        F.first("edge").alias("edge"), F.max("local_size").alias("size"), F.min("local_id").alias("keep_id")
    )
    texts = ends.groupBy("edge").agg(F.sum("size").alias("size"), F.min("keep_id").alias("keep_id"), F.min("bin").alias("first_bin"))
    return ends.select("bin", "head", "edge").join(texts, "edge").drop("edge")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    return sorted_runs(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row per distinct text, all columns kept."""
    return unpack(sorted_runs(docs, id_col, text_col, carry=True), docs.columns)

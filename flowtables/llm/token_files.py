"""Token ids in compressed byte or bit planes.

Documents are dealt into ranges of ascending ids (a shard is one range). Every shard is a stream of chunks of
whole documents, closed once they hold ``CHUNK_IDS`` ids; inside a chunk the ids are cut into blocks of
``BLOCK_IDS``, each block is transposed into planes (all lowest bytes, all second bytes, ... or one plane per bit)
and every plane is compressed by itself with zstandard. The file format is a table with one row per chunk:
the planes, and the chunk index (shard, chunk, place of the first id in its shard, number of ids, ids and lengths of
the documents). A reader needs no neighbour of a chunk, so files may be split anywhere.

Defined results: a null text has the end id only; null ids stand first; repeated rows are written one by one,
rows of one id in the order of their texts' hash; an empty table gives no chunks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtables.llm.common import col, stored, text_or_empty
from flowtables.llm.encoding import encoder

CHUNK_IDS = 1 << 18
BLOCK_IDS = 1 << 16
LEVEL = 3
CHUNKS = "shard int, chunk long, first long, n_ids long, doc_ids array<long>, lengths array<long>, planes array<binary>"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of all blocks of an array of uint32, block by block, lowest plane first."""
    import zstandard

    packer, out = zstandard.ZstdCompressor(level=LEVEL), []
    for at in range(0, len(ids), BLOCK_IDS):
        rows = ids[at : at + BLOCK_IDS].astype("<u4").view(np.uint8).reshape(-1, 4)
        if bits:
            rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little"), axis=0, bitorder="little")
        out.extend(packer.compress(np.ascontiguousarray(rows[:, k]).tobytes()) for k in range(rows.shape[1]))
    return out


def from_planes(planes: list[bytes], n_ids: int, bits: bool = False) -> np.ndarray:
    import zstandard

    opener, each, blocks = zstandard.ZstdDecompressor(), 32 if bits else 4, []
    for k, at in enumerate(range(0, n_ids, BLOCK_IDS)):
        size = min(BLOCK_IDS, n_ids - at)
        rows = np.stack([np.frombuffer(opener.decompress(p), np.uint8) for p in planes[k * each : (k + 1) * each]], axis=1)
        if bits:
            rows = np.packbits(np.unpackbits(rows, axis=0, count=size, bitorder="little"), axis=1, bitorder="little")
        blocks.append(np.ascontiguousarray(rows).view("<u4").ravel())
    return np.concatenate(blocks) if blocks else np.empty(0, "<u4")


def encode_chunks(docs: DataFrame, tokenizer: str, how: str = "spaced", end_id: int = 0, bits: bool = False) -> DataFrame:
    """The chunks of all documents; write them with any writer, or use ``write``."""
    end = np.array([end_id], "<u4").tobytes()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard = encoder(tokenizer, how).encode, TaskContext.get().partitionId()
        ids, lengths, parts, held, first, chunk = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            row = {"shard": shard, "chunk": chunk, "first": first, "n_ids": held, "doc_ids": ids, "lengths": lengths}
            planes = to_planes(np.frombuffer(b"".join(parts), "<u4"), bits)
            return pa.RecordBatch.from_pylist([row | {"planes": planes}], SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py()) + end
                ids.append(doc_id)
                lengths.append(len(data) // 4)
                parts.append(data)
                held += lengths[-1]
                if held >= CHUNK_IDS:
                    yield closed()
                    ids, lengths, parts, held, first, chunk = [], [], [], 0, first + held, chunk + 1
        if ids:
            yield closed()

    ranged = docs.select(col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("tie"))
    ranged = ranged.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ranged.select("doc_id", "text").mapInArrow(chunks, CHUNKS)


SCHEMA = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64())]
    + [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary()))]
)


def write(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the chunks into the shared folder; the result reads them back."""
    return stored(encode_chunks(docs, tokenizer, **options), "token-ids")


def read_documents(chunks: DataFrame, bits: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, ids (drop what is not needed)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = from_planes(row["planes"], row["n_ids"], bits), np.array(row["lengths"], np.int64)
                at = np.concatenate([[0], np.cumsum(lengths)])
                data, n = ids.tobytes(), len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["shard"], np.int32)),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["first"] + at[:-1]),
                        pa.array(lengths),
                        pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()),
                        pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids.astype(np.int64))),
                    ],
                    names=["shard", "doc_id", "local", "n_tokens", "ids_crc32", "ids"],
                )

    decoded = chunks.mapInArrow(documents, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long, ids array<long>")
    return decoded.join(shard_starts(chunks), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")


def read_index(chunks: DataFrame, bits: bool = False) -> DataFrame:
    """As ``read_documents`` without the ids themselves, which then never leave the worker."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = from_planes(row["planes"], row["n_ids"], bits).tobytes()
                at = [row["first"]]
                for n in row["lengths"]:
                    at.append(at[-1] + n)
                crcs = [zlib.crc32(data[4 * (a - at[0]) : 4 * (b - at[0])]) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_pydict(
                    {"shard": [row["shard"]] * len(crcs), "doc_id": row["doc_ids"], "local": at[:-1], "n_tokens": row["lengths"], "ids_crc32": crcs}, INDEX
                )

    decoded = chunks.mapInArrow(documents, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return decoded.join(shard_starts(chunks), "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


INDEX = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def shard_starts(chunks: DataFrame) -> DataFrame:
    """Ids before each shard, from the chunk index alone: one row per shard, so one window over all is small."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

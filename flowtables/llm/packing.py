"""Sequences by power-of-two decomposition.

A document of n ids becomes as many pieces of the longest power of two as fit, and for the rest one piece for each
set bit of its length. Every piece is a sequence of its own: its length is a power of two, so nothing is padded
and no sequence crosses documents. Sequences of equal length form a bucket; the bucket is the highest part of
``sequence_id``, so sorting or partitioning by it puts equal lengths together. No shuffle is needed.

Defined results: a null text has the end id only; repeated rows and ids are packed one by one; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowtables.llm.common import col, text_or_empty
from flowtables.llm.encoding import encoder

LONGEST = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# sequence_id = bucket (4 bits and the sign) | task (24 bits) | number within task and bucket (34 bits)
BUCKET_SHIFT, TASK_SHIFT = 58, 34


def lengths_of(n: int, longest: int = LONGEST) -> list[int]:
    """Power-of-two lengths that sum to n, longest first."""
    top = 1 << (longest.bit_length() - 1)
    rest = n % top
    return [top] * (n // top) + [1 << k for k in reversed(range(top.bit_length() - 1)) if rest >> k & 1]


def pack(
    docs: DataFrame, tokenizer: str, how: str = "words", end_id: int = 1, longest: int = LONGEST, with_ids: bool = False, remembered: int | None = None
) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves. ``remembered`` bounds what a worker keeps, see ``encoding``."""
    end = np.array([end_id], "<u4").tobytes()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task, used = encoder(tokenizer, how, remembered).encode, TaskContext.get().partitionId() << TASK_SHIFT, {}
        for batch in batches:
            out: list[list] = [[] for _ in range(8 if with_ids else 7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py()) + end
                n, start = len(data) // 4, 0
                for length in lengths_of(n, longest):
                    number = used.get(length, 0)
                    used[length] = number + 1
                    part = data[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(part), n, ((length.bit_length() - 1) << BUCKET_SHIFT) + task + number, 0)
                    for values, value in zip(out, row, strict=False):
                        values.append(value)
                    if with_ids:
                        out[7].append(np.frombuffer(part, "<u4").astype(np.int32))
                    start += length
            arrays = [pa.array(v, pa.int64()) for v in out[:7]] + ([pa.array(out[7], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(pieces, schema)

"""Exact top-k by inner product with bounds from segment statistics.

A vector is cut into segments; with the mean and deviation of each, the inner product of two vectors is at most the
sum over segments of length * (mean * mean + deviation * deviation). In terms of distance this is the usual lower bound
(|x|^2 + |q|^2 - 2 * product). Bounds are taken coarse to fine (``LEVELS`` segments); a candidate that cannot
reach a query's k-th best so far is dropped for it, and exact products are computed for the survivors only.

Queries are handled in blocks of bounded size, each sent to all tasks; each task keeps k rows per query. A first
look at a bounded sample of candidates gives a valid k-th best to begin with, which changes the work, not the result.

Defined results: components x count as floor(1024 * x) of the double; rows without an id and vectors that are
null or hold null or non-finite components take no part; vectors of different lengths are not compared; repeated rows
are one query but several candidates; a row never finds its own id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.llm.common import col

SCALE = 1024
LEVELS = (1, 4, 16)
QUERY_BLOCK = 2048
SAMPLE = 4096
CHUNK = 4096


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part."""
    v = col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(col(id_col).isNotNull() & v.isNotNull() & finite).select(col(id_col).cast("bigint").alias("id"), v.alias("v"))


@dataclass(frozen=True)
class Block:
    """Queries of one vector length, with the best rows found so far."""

    ids: np.ndarray
    rows: np.ndarray
    floor: np.ndarray  # no result of a query scores less


def segments(rows: np.ndarray, n: int) -> np.ndarray:
    """Root-weighted means and deviations of n segments: inner products of these bound those of the rows."""
    width = rows.shape[1]
    edges = np.linspace(0, width, min(n, width) + 1).astype(int)
    size = np.diff(edges)
    means = np.add.reduceat(rows, edges[:-1], axis=1) / size
    squares = np.add.reduceat(rows * rows, edges[:-1], axis=1) / size
    deviations = np.sqrt(np.maximum(squares - means * means, 0))
    return np.hstack([means, deviations]) * np.sqrt(np.concatenate([size, size]))


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; those beyond 64 bits saturate."""
    top = max(np.abs(rows).max(initial=0), 1) * max(np.abs(queries).max(initial=0), 1) * max(rows.shape[1], 1)
    if top < 2**53:
        return (rows @ queries.T).astype(np.int64)
    whole = lambda a: np.array([[int(x) for x in r] for r in a], dtype=object).reshape(a.shape)
    exact = whole(rows) @ whole(queries).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best candidates of each query among those seen."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.least = block.floor.copy()
        self.query = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.levels = [segments(block.rows, n) for n in LEVELS] if block.rows.shape[1] else []
        self.norms = np.sqrt((block.rows * block.rows).sum(axis=1))

    def see(self, ids: np.ndarray, rows: np.ndarray) -> None:
        norms = np.sqrt((rows * rows).sum(axis=1))
        alive = ids[:, None] != self.block.ids[None, :]
        for n, known in zip(LEVELS, self.levels, strict=False):
            some = alive.any(axis=1)
            if not some.all():
                ids, rows, norms, alive = ids[some], rows[some], norms[some], alive[some]
            if not len(ids):
                return
            slack = 1e-9 * norms[:, None] * self.norms[None, :] + 1e-6
            alive &= segments(rows, n) @ known.T + slack >= self.least[None, :]
        some = np.flatnonzero(alive.any(axis=1))
        if not len(some):
            return
        exact = products(rows[some], self.block.rows)
        at, query = np.nonzero(alive[some] & (exact >= self.least[None, :]))
        self._merge(query, ids[some][at], exact[at, query])

    def _merge(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.score, scores)))
        order = np.lexsort((ids, ~scores, query))  # ~x falls as x rises, without overflow
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        last = place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], scores[last])
        self.query, self.id, self.score = query[kept], ids[kept], scores[kept]


def _by_length(ids: np.ndarray, vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(v) for v in vectors])
    for n in np.unique(lengths):
        pick = np.flatnonzero(lengths == n)
        yield ids[pick], np.floor(np.stack([vectors[i] for i in pick]) * SCALE) if n else np.zeros((len(pick), 0))


def _blocks(queries: list, sample: list, k: int) -> dict[int, Block]:
    out = {}
    shown = {rows.shape[1]: (ids, rows) for ids, rows in _by_length(np.array([r["id"] for r in sample]), [np.array(r["v"], float) for r in sample])}
    for ids, rows in _by_length(np.array([r["id"] for r in queries]), [np.array(r["v"], float) for r in queries]):
        block = Block(ids, rows, np.full(len(ids), -np.inf))
        if rows.shape[1] in shown:
            best = Best(block, k)
            seen_ids, seen = shown[rows.shape[1]]
            for at in range(0, len(seen_ids), 512):
                best.see(seen_ids[at : at + 512], seen[at : at + 512])
            block = Block(ids, rows, best.least)
        out[rows.shape[1]] = block
    return out


def _search(candidates: DataFrame, blocks: dict[int, Block], k: int) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast(blocks)  # at most about QUERY_BLOCK vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(block, k) for n, block in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                ids, vectors = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
                for some, rows in _by_length(ids, list(vectors)):
                    if rows.shape[1] in best:
                        best[rows.shape[1]].see(some, rows)
        for b in best.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.block.ids[b.query]), pa.array(b.id), pa.array(b.score)], names=["query_id", "vec_id", "score"]
            )

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: per query row its k best other rows by inner product, ties to the smaller id."""
    candidates = whole_vectors(df, id_col, vector_col)
    queries = whole_vectors(df.where(is_query), id_col, vector_col).distinct()
    blocks = -(-queries.count() // QUERY_BLOCK)
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    found = []
    for b in range(max(1, blocks)):
        mine = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, blocks))) == b).collect()
        found.append(_search(candidates, _blocks(mine, sample, k), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

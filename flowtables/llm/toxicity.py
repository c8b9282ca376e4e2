"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, of neighbouring pairs and of pairs with one word between. The
fit sees at most ``TRAINING_ROWS`` labelled documents (those with the smallest hash of their id), one at a time, with
a learning rate per coordinate and an L1 bound that leaves most weights at exactly zero; only the others
travel to the tasks that score all documents.

Defined results: null and empty texts have no features and get the score of the intercept; rows without a label or an
id are not learned from; without any labelled row every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtables.llm.common import col, crc_text, text_or_empty
from flowtables.llm.hashing import mix, word_hashes

BITS = 20
TRAINING_ROWS = 8_000
EPOCHS, ALPHA, BETA, L1, L2 = 5, 2.0, 1.0, 6.0, 0.0
_BATCH = 256
_PAIR, _SKIP = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


@dataclass(frozen=True)
class Weights:
    """The coordinates whose weight is not zero, and the intercept."""

    index: np.ndarray
    value: np.ndarray
    intercept: float
    fitted: bool = True

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.index] = self.value
        return dense


def features(words: np.ndarray) -> np.ndarray:
    """Hashed features of one text, repeats included."""
    parts = [words, mix(words[:-1] * _PAIR + words[1:]), mix(words[:-2] * _SKIP + words[2:])]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(examples: list[tuple[np.ndarray, int]]) -> Weights:
    """FTRL-proximal over (distinct features, label) in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = bias = 0.0
    for _ in range(EPOCHS):
        for index, label in examples:
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            n[index] = ni + g * g
            z[index] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            # The intercept is one more coordinate, without L1.
            step = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA
            bias_n, bias_z = bias_n + g * g, bias_z + g - step * bias
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    index = np.flatnonzero(np.abs(z) > L1)
    zi = z[index]
    value = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[index])) / ALPHA + L2)
    return Weights(index, value, bias, bool(examples))


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [x.as_py() for x in batch.column(0).slice(at, _BATCH).cast(pa.binary())]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, rows: int = TRAINING_ROWS) -> Weights:
    """Fits on at most ``rows`` labelled documents; ``learn`` restricts which labels may be used.

    Repeated labels count once, and of repeated documents the text that sorts first is taken, so ``rows`` bounds what is collected.
    """
    usable = labels.where(col(label).isNotNull() & col("doc_id").isNotNull() & (F.lit(True) if learn is None else learn))
    chosen = usable.select(col("doc_id").cast("bigint").alias("id"), col(label).cast("int").alias("label")).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    # Bounded by the parameter ``rows``: 12 bytes each.
    joined = docs.select(col("doc_id").cast("bigint").alias("id"), text_or_empty().alias("text")).join(F.broadcast(chosen), "id")
    joined = joined.groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                found = [np.unique(features(w)).astype(np.uint32).tobytes() for w in word_hashes(_texts(batch, at), plain=True)]
                part = batch.slice(at, _BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), part.column(1), part.column(2)], names=["found", "id", "label"])

    taken = joined.select("text", "id", "label").mapInArrow(run, "found binary, id long, label int").orderBy(F.xxhash64("id"), "id", "label", "found").collect()
    return fit([(np.frombuffer(r["found"], np.uint32).astype(np.int64), r["label"]) for r in taken])


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """One row per document: doc_id, score."""
    table = docs.sparkSession.sparkContext.broadcast(weights)  # as large as the non-zero weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = table.value
        dense = model.table()
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                totals = []
                for words in word_hashes(_texts(batch, at), plain=True):
                    found = features(words)
                    totals.append(dense[np.unique(found[dense[found] != 0])].sum() + model.intercept)
                chance = 1 / (1 + np.exp(-np.clip(np.array(totals), -35, 35))) if model.fitted else np.zeros(len(totals))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, _BATCH), pa.array(chance, pa.float64())], names=["doc_id", "score"])

    return docs.select(text_or_empty().alias("text"), col("doc_id").cast("bigint").alias("doc_id")).mapInArrow(run, "doc_id long, score double")


def score_with_held_out(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; the fold ``held`` of crc32(doc_id) is never learned from."""
    fold = lambda: F.pmod(crc_text("doc_id"), F.lit(folds))
    scored = score(docs, train(docs, labels, learn=fold() != held))
    return scored.select("doc_id", (fold() == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

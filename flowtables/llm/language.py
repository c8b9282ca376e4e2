"""Language identification with error-correcting output codes.

Every language has a codeword of bits, far from the others'; one linear classifier per bit, over hashed letter
2- and 3-grams, says how likely the bit is set. A text gets the language whose codeword costs least: the
logistic loss of every bit, weighted by how reliable the bit's classifier was on its training rows. Close seconds are
flagged as ambiguous.

The fit sees at most ``ROWS_PER_LANGUAGE`` documents of each language (those with the smallest hash of their id)
and ``TOTAL_ROWS`` in all.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows without a language or an id
are not learned from; without any such row every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtables.llm.common import col, crc_text, unpack, whole_row

BITS = 12
ROWS_PER_LANGUAGE = 800
TOTAL_ROWS = 20_000  # 8 KB each in the fit, compressed on the way to the driver
EPOCHS, RATE, DECAY = 12, 0.5, 1e-5
AMBIGUOUS = 0.2
UNKNOWN = "und"
_BATCH = 128
_SEGMENT = 1 << 20

_alphanumeric = re.compile(r"[^\W\d_]")
_AS_SPACE = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalpha():
        _AS_SPACE[_b] = 32


@dataclass(frozen=True)
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit, -1 or 1
    weights: np.ndarray  # feature x bit
    intercepts: np.ndarray
    trust: np.ndarray  # per bit


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """All distinct splits of the languages while these are few, else the best of several random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([[1 if k == 0 or (b >> (k - 1)) & 1 else -1 for b in range((1 << (n - 1)) - 1)] for k in range(n)], float)
    draw, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = (draw.choice([-1.0, 1.0], (n, bits)) for _ in range(50))
    return max(tries, key=lambda m: min((a != b).sum() for a, b in combinations(m, 2)))


def counts(text: str) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of the lower-cased letters; anything else counts as a space."""
    out = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(text), _SEGMENT):
        part = text[max(0, at - 2) : at + _SEGMENT].lower()
        b = _AS_SPACE[np.frombuffer(f" {part} ".encode(), np.uint8)].astype(np.uint32)
        if len(b) < 3:
            continue
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        for grams, scale in ((two, np.uint32(2654435761)), (three, np.uint32(2246822519))):
            out += np.bincount(grams * scale >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def vector(text: str) -> np.ndarray:
    found = counts(text)
    return np.sqrt(found / max(1, found.sum()), dtype=np.float64).astype(np.float32)


def packed(found: np.ndarray) -> bytes:
    """A vector as the fit takes it; counts of n-grams take few values, so this is a fraction of its 8 KB."""
    return zlib.compress(found.astype(np.float16).tobytes())


def unpacked(found: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(found), np.float16)


def fit(rows: np.ndarray, languages: list[str]) -> Model:
    """One logistic classifier per bit, all trained together by gradient steps with a rate per coordinate."""
    names = sorted(set(languages))
    codes = codewords(len(names))
    place = {name: k for k, name in enumerate(names)}
    signs = codes[[place[x] for x in languages]] if names else codes
    bits = codes.shape[1]
    weights, intercepts = np.zeros((1 << BITS, bits)), np.zeros(bits)
    seen_w, seen_b = np.full_like(weights, 1e-4), np.full_like(intercepts, 1e-4)
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x, y = rows[pick].astype(np.float64), signs[pick]
            g = -y / (1 + np.exp(np.clip(y * (x @ weights + intercepts), -35, 35))) / len(pick)
            gw, gb = x.T @ g + DECAY * weights, g.sum(axis=0)
            seen_w += gw * gw
            seen_b += gb * gb
            weights -= RATE * gw / np.sqrt(seen_w)
            intercepts -= RATE * gb / np.sqrt(seen_b)
    right = np.ones(bits)
    if len(rows):
        parts = [slice(at, at + 1024) for at in range(0, len(rows), 1024)]
        right = sum(((rows[p].astype(np.float64) @ weights + intercepts) * signs[p] > 0).sum(axis=0) for p in parts) / len(rows)
    return Model(names, codes, weights.astype(np.float32), intercepts.astype(np.float32), np.clip(2 * right - 1, 0.05, 1))


def decode(model: Model, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) per row."""
    margins = rows @ model.weights + model.intercepts
    losses = np.logaddexp(0, -margins[:, None, :] * model.codes[None]) @ model.trust
    chance = np.exp(-(losses - losses.min(axis=1, keepdims=True)))
    chance /= chance.sum(axis=1, keepdims=True)
    best = chance.argmax(axis=1)
    top = np.sort(chance, axis=1)
    second = top[:, -2] if chance.shape[1] > 1 else np.zeros(len(rows))
    return best, top[:, -1], top[:, -1] - second < AMBIGUOUS


def train(docs: DataFrame, learn: Column | None = None, rows: int = ROWS_PER_LANGUAGE, total: int = TOTAL_ROWS) -> Model:
    """Fits on at most ``rows`` documents per language and ``total`` in all, shared evenly; ``learn`` restricts which may be used.

    Of repeated documents the text that sorts first is taken, so ``total`` bounds what is collected.
    """
    usable = docs.where(col("lang").isNotNull() & col("doc_id").isNotNull() & col("text").isNotNull() & (F.lit(True) if learn is None else learn))
    named = usable.select(col("doc_id").cast("bigint").alias("id"), col("lang").alias("lang"))
    # Only ids whose hash can be among the lowest meet in a language's window: about twice the rows wanted.
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # One row per language; the model itself holds as many on every machine.
    sizes = F.broadcast(named.groupBy("lang").agg(F.count("*").alias("n")))
    likely = named.join(sizes, "lang").where(place * F.col("n") <= 2 * rows).select("id", "lang").distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(place, "id"))
    chosen = likely.select("id", "lang", turn.alias("turn")).where(F.col("turn") <= rows)
    chosen = chosen.orderBy("turn", "lang", "id").limit(total).select("id", "lang")
    # Bounded by ``total``: about 20 bytes each.
    picked = usable.select(col("text").alias("text"), col("doc_id").cast("bigint").alias("id"), col("lang").alias("lang")).join(F.broadcast(chosen), ["id", "lang"])
    picked = picked.groupBy("id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(vector(x.as_py())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], names=["found", "id", "lang"])

    taken = picked.select("text", "id", "lang").mapInArrow(run, "found binary, id long, lang string").orderBy("lang", "id", "found").collect()
    rows_ = np.empty((len(taken), 1 << BITS), np.float16)
    for k, r in enumerate(taken):
        rows_[k] = unpacked(r["found"])
    return fit(rows_, [r["lang"] for r in taken])


def _has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _alphanumeric.finditer(text))


def _predictions(texts: list[str | None], model: Model) -> tuple[list[str], list[float], list[bool]]:
    known = [k for k, t in enumerate(texts) if t is not None and model.languages and _has_letter(t)]
    names, scores, unclear = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if known:
        for k, best, score, ambiguous in zip(known, *decode(model, np.stack([vector(texts[k]) for k in known])), strict=True):
            names[k], scores[k], unclear[k] = model.languages[best], float(score), bool(ambiguous)
    return names, scores, unclear


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features times bits, whatever the documents
    kept = docs.select(col("text").cast("string").alias("text"), whole_row(docs).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                found = _predictions(part.column(0).to_pylist(), shared.value)
                kinds = (pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), *[pa.array(v, k) for v, k in zip(found, kinds, strict=True)]], names=["row", "lang_pred", "score", "ambiguous"]
                )

    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField("row", kept.schema["row"].dataType), T.StructField("lang_pred", T.StringType())]
        + [T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    )
    return kept.mapInArrow(run, schema)


def predict_with_held_out(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; the fold ``held`` of crc32(doc_id) is never learned from."""
    fold = lambda: F.pmod(crc_text("doc_id"), F.lit(folds))
    model = train(docs, learn=fold() != held)
    narrow = docs.select(col("doc_id").cast("bigint").alias("doc_id"), col("text").alias("text"))
    found = predict(narrow, model).select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score", "ambiguous")
    return found.select("doc_id", (fold() == held).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents whose language is clear; those without a letter or with two about equally likely languages go."""
    found = predict(docs, model or train(docs))
    return unpack(found.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")), docs.columns)

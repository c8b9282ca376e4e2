"""Toxicity, language and personal data: held-out accuracy, labels that must not matter, fixed patterns by brute force."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import odd_docs  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from flowtables.llm import language, pii, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _auc(scores, truth):
    order = np.argsort(np.argsort(scores)) + 1
    ones = truth.sum()
    return (order[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(truth) - ones))


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score_with_held_out(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert _auc(held.score.values, held.toxic.values) > 0.7
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    flipped = labels.withColumn("toxic", F.when(fold == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.score_with_held_out(docs.withColumn("lang", F.lit("zz")), flipped).toPandas()
    assert got.sort_values("doc_id").score.tolist() == other.sort_values("doc_id").score.tolist()


def test_toxicity_odd_rows(spark):
    rows = odd_docs(spark)
    labels = spark.createDataFrame([(1, None), (None, 1), (7, 1), (7, 1), (14, 0)], "doc_id long, toxic int")
    got = toxicity.score_with_held_out(rows, labels).collect()
    assert len(got) == rows.count() and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.score_with_held_out(rows, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.0}
    assert toxicity.score_with_held_out(rows.limit(0), labels).count() == 0


def test_language_held_out(docs):
    got = language.predict_with_held_out(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_odd_rows(spark):
    rows = odd_docs(spark)
    model = language.train(rows)
    got = language.predict(rows, model).select("row.*", "lang_pred", F.col("score").alias("s")).collect()
    assert len(got) == rows.count()
    for r in got:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == lettered and 0 <= r.s <= 1
    kept = language.keep_identified(rows, model)
    assert kept.schema.names == rows.schema.names and kept.where("text IS NULL OR trim(text) = ''").count() == 0
    assert language.predict_with_held_out(rows.limit(0)).count() == 0
    assert {r.lang_pred for r in language.predict(rows, language.train(rows.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 30])
def test_codewords_differ(n):
    codes = language.codewords(n)
    distances = [(a != b).sum() for i, a in enumerate(codes) for b in codes[:i]]
    assert len(codes) == n and (n < 2 or min(distances) >= (1 if n == 2 else codes.shape[1] // 4))


# The base patterns as the contract writes them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def _base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if _passes(k, m[0]))


ODD_TEXTS = [
    None, "", "a@b.c._x@y.z foo@bar@x.y a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255 1.2.3", "4111 1111 1111 1111-1 4111-1111-1111-1111 12 34 5",
    "++1 555 123 4567) +1(2", "é@x.com ü😀 a@b.co +49 30 1234567. 😀 4111 1111 1111 1111", "1 " * 3000, "1." * 3000, "@".join("a" * 500), "a@b" + ".c" * 2000,
    "9" * 5000, "99999999999.1.1.1 +1234567890123456 +(1) 23",
]


def test_base_spans(spark, docs):
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(ODD_TEXTS)], "doc_id long, text string"))
    got = pii.report(texts).collect()
    known = {r.doc_id: r.text for r in texts.collect()}
    assert len(got) == len(known)
    for r in got:
        want = _base(known[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want.count(f"{k}:") for k in PATTERNS)
        spans = r.spans.split(",") if r.spans else []
        assert set(filter(None, want.split(","))) <= set(spans) and len(spans) == len(set(spans)) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_added_spans(spark):
    model = pii.Model([(1.0, 1.0)], {k: 0.6 for k in range(4)})
    texts = ["call (555) 123-4567 or 555-123-4567", "john (at) example (dot) com", "ip 192[.]168[.]0[.]1", "card 4111/1111/1111/1111", "on 2021-03-15 10 it was", "1. 2. 3. 4", "5 @ 3.50 each", "home at last. Then"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.stop] for s in r.spans] for r in pii.find_spans(docs, model).collect()}
    assert got == {
        0: ["(555) 123-4567", "555-123-4567"], 1: ["john (at) example (dot) com"], 2: ["192[.]168[.]0[.]1"], 3: ["4111/1111/1111/1111"], 4: [], 5: [], 6: [], 7: []
    }


def test_rare_kinds_get_a_threshold(spark):
    def text(k):
        return f"mail a{k}@b.org card 4111 1111 1111 {1000 + k}" + (f" ip 10.0.0.{k % 200}" if k % 100 == 7 else " call +49 30 12345 678" if k == 5 else "")

    model = pii.train(spark.createDataFrame([(k, text(k)) for k in range(1000)], "doc_id long, text string"), 60)
    assert {pii.KINDS[k] for k in model.thresholds} >= {"email", "ip", "phone"}


def test_thresholds_of_counts():
    rows = [(0, 0.9, 1.0, 95), (0, 0.8, 1.0, 5), (0, 0.7, 0.0, 1), (0, 0.6, 0.0, 50), (1, 0.9, 0.0, 9)]
    assert pii._thresholds(rows) == {0: 0.9} and pii._thresholds([*rows, (0, 0.85, 1.0, 1)]) == {0: 0.85}
    assert pii._levels([(0, 1.0, 3, 2), (0, 1.0, 1, 5), (0, 1.0, 7, 9), (1, 0.0, 2, 99)], 10) == {(0, 1.0): 3, (1, 0.0): 2}


def test_pii_odd_rows(spark):
    rows = odd_docs(spark)
    assert pii.report(rows).count() == rows.count() and pii.report(rows.limit(0)).count() == 0


def test_fits_are_bounded_by_rows_not_ids(spark, monkeypatch):
    """Two ids with thousands of rows each, and many languages: what reaches the driver keeps the bounds, and repeats change nothing."""
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda examples: seen.update(toxicity=examples) or toxicity.Weights(np.zeros(0, np.int64), np.zeros(0), 0.0, False))
    monkeypatch.setattr(language, "fit", lambda rows, names: seen.update(rows=rows, names=names))
    docs = spark.range(6000).selectExpr("id % 2 AS doc_id", "concat('word ', 'x', id % 50) AS text", "IF(id % 2 = 0, 'en', 'de') AS lang")
    labels = spark.range(40).selectExpr("id % 2 AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    toxicity.train(docs, labels)
    assert len(seen["toxicity"]) == 2
    language.train(docs)
    assert seen["rows"].shape[0] == 2 and seen["names"] == ["de", "en"]
    once = docs.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    before = seen["rows"]
    language.train(once)
    assert (seen["rows"] == before).all()
    many = spark.range(900).selectExpr("id AS doc_id", "'some text' AS text", "concat('l', id % 90) AS lang")
    language.train(many, rows=8, total=270)
    assert len(seen["names"]) == 270 and {seen["names"].count(x) for x in seen["names"]} == {3}


def test_language_rows_travel_packed(spark, docs, monkeypatch):
    """What training fetches is a fraction of the vectors it fits on, and these stay the same to the last bit."""
    kind, fetched, seen = type(docs), [], {}
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: fetched.append(collect(self)) or fetched[-1])
    monkeypatch.setattr(language, "fit", lambda rows, names: seen.update(rows=rows, names=names))
    few = docs.where("doc_id < 60")
    language.train(few)
    rows = [r for got in fetched for r in got if "found" in r.asDict()]
    texts = {(r.lang, r.doc_id): r.text for r in collect(few)}
    want = [language.vector(texts[key]).astype(np.float16) for key in sorted(k for k in texts if None not in k)]
    assert len(rows) == len(want) > 10 and seen["rows"].dtype == np.float16 and (seen["rows"] == np.stack(want)).all()
    assert sum(len(r.found) for r in rows) < 0.4 * seen["rows"].nbytes

"""Exact and near dedup against plain versions."""

import hashlib
import os
import random
import sys
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import SPACES, near_components, odd_docs, odd_rows, sentence, shingle_set  # noqa: E402

from flowtables.llm import components, exact_dedup, near_dedup  # noqa: E402


@pytest.mark.parametrize("rows_per_bin", [16, 1])
def test_exact_copies(spark, monkeypatch, rows_per_bin):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_BIN", rows_per_bin)
    rows = odd_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[SPACES.sub(" ", r[1] or "")].append(r[0])
    found = exact_dedup.find_copies(odd_docs(spark)).collect()
    assert len(found) == len(rows)
    kept = defaultdict(int)
    for r in found:
        mine = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(mine) and r.keep_id == min(i for i in mine if i is not None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_copies_dropped(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_BIN", 1)
    docs = odd_docs(spark)
    left = exact_dedup.drop_copies(docs)
    assert left.schema.names == docs.schema.names
    rows = left.collect()
    assert len(rows) == len({SPACES.sub(" ", r[1] or "") for r in odd_rows()}) == len({SPACES.sub(" ", r.text or "") for r in rows})
    assert set(map(tuple, rows)) <= set(odd_rows())


def test_one_text_fills_many_bins(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_BIN", 1)
    docs = spark.range(500).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat('t', id), 'same') AS text")
    got = exact_dedup.find_copies(docs).collect()
    assert all((r.group_size, r.keep_id, r.kept) == ((1, r.doc_id, True) if r.doc_id % 3 == 0 else (333, 1, r.doc_id == 1)) for r in got)


def _near(spark, rows, words):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.find_near_copies(docs, words=words).collect()
    want = near_components(rows, words)
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return found


def test_near_copies_of_odd_rows(spark):
    found = _near(spark, [(r[0], r[1]) for r in odd_rows()], 4)
    sizes = defaultdict(set)
    for i, text in [(r[0], r[1]) for r in odd_rows()]:
        sizes[i].add(len(shingle_set(text, 4)))
    assert all(r.n_shingles in sizes[r.doc_id] for r in found)


def test_links_beside_the_centre(spark, monkeypatch):
    """A base with many edited copies that are close to it but not to each other, and chains of edits."""
    monkeypatch.setattr(near_dedup, "BLOCK", 1024)
    monkeypatch.setattr(near_dedup, "MEMBERS_PER_TASK_GROUP", 4)
    draw = random.Random(3)
    base = sentence(draw, 200).split()
    rows = [(500, " ".join(base))]
    for k in range(40):
        edited = list(base)
        for at in draw.sample(range(200), 4):
            edited[at] = f"w{k}x{at}"
        rows.append((100 + k, " ".join(edited)))
    chain = sentence(draw, 150).split()
    for k in range(12):
        chain[k * 12] = chain[k * 12 + 3] = f"c{k}"
        rows.append((k, " ".join(chain)))
    found = _near(spark, rows, 4)
    assert len({r.component_id for r in found}) < 6


def test_empty_tables(spark):
    docs = odd_docs(spark, [])
    assert exact_dedup.find_copies(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0
    assert near_dedup.find_near_copies(docs).count() == 0


def test_signature_agrees_with_similarity():
    import numpy as np

    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**64, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], draw.integers(0, 2**64, 100, dtype=np.uint64)])
    same = (near_dedup.signature(np.unique(a)) == near_dedup.signature(np.unique(b))).mean()
    assert abs(same - 900 / 1100) < 0.12


def test_components_and_their_extension(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7), (None, 3)]
    more = [(draw.randrange(300), draw.randrange(300)) for _ in range(40)] + [(1060, 5), (2000, 2001), (9, None), (1003, 1040)]

    def plain(pairs):
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            if a is not None and b is not None and a != b:
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        return {x: top(x) for x in up}

    first = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in first.collect()} == plain(edges)
    wider = components.extend(first, spark.createDataFrame(more, "a long, b long")).collect()
    assert len(wider) == len({r.id for r in wider}) and {r.id: r.component for r in wider} == plain(edges + more)
    none = spark.createDataFrame([], "a long, b long")
    assert components.extend(components.components(none), none).collect() == []


def _stages(spark, work):
    """How many stages ran for it."""
    before = {j for g in (None, "work") for j in spark.sparkContext.statusTracker().getJobIdsForGroup(g)}
    spark.sparkContext.setJobGroup("work", "work")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in set(tracker.getJobIdsForGroup("work")) - before for s in tracker.getJobInfo(j).stageIds}
    return sum(tracker.getStageInfo(s) is not None for s in stages)


def test_components_take_few_stages(spark):
    """The driver pays for every stage: links that are stars already need no step, and a step no second one to see its end."""
    stars = spark.createDataFrame([(k, k % 7) for k in range(7, 400)], "a long, b long")
    more = spark.createDataFrame([(7 * k, 7 * k + 1) for k in range(1, 20)], "a long, b long")
    found = []
    first = _stages(spark, lambda: found.append(components.components(stars).localCheckpoint()))
    second = _stages(spark, lambda: found.append(components.extend(found[0], more).localCheckpoint()))
    assert {r.id: r.component for r in found[0].collect()} == {k: k % 7 for k in range(400)}
    assert {r.id: r.component for r in found[1].collect()} == {k: 0 if k % 7 < 2 else k % 7 for k in range(400)}
    assert first <= 10 and second <= 40

"""The prefix trie against a plain trie of dictionaries."""

import hashlib
import os
import random
import re
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import WORDS  # noqa: E402

from flowtables.llm import prefix_trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, path string, shard int, `a.b` double"


def tie(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    own = {}
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, tie(r[2], r[3]))):
        own.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p for q in below if q)]
        saved = sum((len(nodes[p]) - 1) * len(WORDS.findall(p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(path))))
        children = sum(1 for q in below if len(q) == len(path) + 1)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations(seed):
    draw = random.Random(seed)
    said = [None, "", " ", "hi there", "what is it", "a\nb  c", "é 漢字"]
    rows = []
    for c in range(-25, 130):
        for t in range(draw.randint(1, 5)):
            text = said[draw.randrange(len(said))] if c % 3 else "one common turn"
            rows.append((c, None if t == 4 else t, ["user", "assistant", None][t % 3] if c % 5 else "user", text, "p", 1, 0.5))
    rows += [(None, 1, "user", "lost", None, None, None), (7, 0, "user", "tie", "p", 1, 1.0), (7, 0, "user", "another tie", "p", 1, 1.0), rows[3], rows[3]]
    rows = [r for r in rows if r[0] != 60]
    return rows + [(10**15, t, "user", f"long {t % 7}", "p", 1, 1.0) for t in range(300)]


@pytest.mark.parametrize(("seed", "shards"), [(1, None), (2, 1), (3, 40)])
def test_odd_conversations(spark, monkeypatch, seed, shards):
    if shards:
        real = prefix_trie._sharded
        monkeypatch.setattr(prefix_trie, "_sharded", lambda s, n: real(s, shards))
    rows = odd_conversations(seed)
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == prefix_trie.NODE
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_copies_fill_many_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 40)
    real = prefix_trie._sharded
    monkeypatch.setattr(prefix_trie, "_sharded", lambda s, n: real(s, 16))
    rows = [(c, t, "user", f"turn {t}" if c % 3 else f"own {c}", None, None, None) for c in range(0, 600) for t in range(3)]
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_too_large_skeleton_takes_fewer_shards(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MOST_SKELETON", 3)
    rows = [(c, t, "user", f"turn {t}", None, None, None) for c in range(200) for t in range(6)]
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_empty_table(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([(None, 1, "user", "x", None, None, None)], SCHEMA)).count() == 0


def test_words_are_the_words_meant():
    assert WORDS.findall("a\x0bb\x1cc d") == ["a", "b\x1cc", "d"] and re.findall(prefix_trie.WORD, "a b") == ["a", "b"]

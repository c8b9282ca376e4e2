"""Alignment of two tokenizers against the unchanged libraries on whole texts."""

import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import odd_docs, odd_rows, sentence  # noqa: E402

from flowtables.llm import alignment  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Rows of the report, from whole texts and byte offsets."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = {c: k for k, c in enumerate(sorted(ByteLevel.alphabet()))}
    names = {}
    for byte in range(256):
        if byte in (*range(33, 127), *range(161, 173), *range(174, 256)):
            names[chr(byte)] = byte
    names |= {chr(256 + k): byte for k, byte in enumerate(x for x in range(256) if x not in names.values())}
    assert set(names) == set(alphabet)
    aligned = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = b.encode(text or "")
        parts_a = [bytes(names[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = []
        for i in ids_b:
            p = b.id_to_piece(i)
            parts_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            aligned.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in parts_a]).tolist(), np.cumsum([len(x) for x in parts_b]).tolist()
        at = dict(zip(ends_b, ids_b, strict=True))
        links = [(x, at[e]) for x, e in zip(ids_a, ends_a, strict=True) if e in at]
        common, sides = set(ends_a) & set(ends_b), []
        for ids, ends in ((ids_a, ends_a), (ids_b, ends_b)):
            parts, ids_now = [], []
            for i, e in zip(ids, ends, strict=True):
                ids_now.append(str(i))
                if e in common:
                    parts.append(",".join(ids_now))
                    ids_now = []
            sides.append(parts)
        aligned.append((len(ids_a), len(ids_b), ["|".join(g) for g in zip(*sides, strict=True)], links))
    counts = Counter(pair for x in aligned if x for pair in x[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for x in aligned:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


TRICKY = [
    "two  spaces and a\ttab", " leading", "trailing ", "\n\nlines\n\n\nmore  \n x", "<|endoftext|> and <s> </s> <unk> <0x41>", "under▁score ▁", "it's we'll I'D",
    " hard space 　wide ", "漢字かな交じり文 テスト", "🙂👍🏽 é ﬁ Ⅷ", "a\x00b \x1c c\x85d", "x" * 300, "1234567890 3.14 0x1F", "Å é ü ß", "  ﻿ bom", "  ", "▁", "a ▁ b",
]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = alignment.align_corpus(docs, A, B).collect()
    want = Counter((i, *w) for (i, _), w in zip(rows, plain([t for _, t in rows]), strict=True))
    assert len(found) == len(rows)
    assert Counter(map(tuple, found)) == want
    return found


def test_odd_and_tricky_texts(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [(1000 + k, t) for k, t in enumerate(TRICKY)] + [(2000, " ".join(TRICKY)), (2001, "\n".join(TRICKY[:5]))]
    found = {r.doc_id: r for r in check(spark, rows)}
    assert found[1005].n_a == 0 and found[1005].groups_sha256 == "" and found[1004].n_a > 0


def all_keys(tool, texts):
    found = b"".join(facts[p][2] for held, _, facts in tool.blocks(texts) for _, part in held for p in part)
    return np.frombuffer(found, "<u8")


@pytest.mark.parametrize("segment", [40, 400])
def test_texts_in_segments(monkeypatch, segment):
    draw = random.Random(4)
    tool = alignment.Aligner(A, B)
    texts = [sentence(draw, 700), sentence(draw, 300) + " ▁ " + sentence(draw, 300), " ".join(TRICKY), "", "one", None]
    keys = all_keys(tool, texts)
    index = alignment.PerfectHash(np.unique(keys))
    counts = np.arange(len(index.keys))
    best = counts % 2 == 0
    want = alignment._report(tool, texts, index, counts, best)
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    fresh = alignment.Aligner(A, B)
    assert sorted(all_keys(fresh, texts)) == sorted(keys)
    got = alignment._report(fresh, texts, index, counts, best)
    assert (got[0] == want[0]).all() and got[1] == want[1] and want[0][1, 0] == 0 < want[0][0, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    index = alignment.PerfectHash(keys)
    assert sorted(index.find(keys).tolist()) == list(range(len(keys)))
    assert (index.find(keys ^ np.uint64(1 << 40)) == -1).all()


def test_counts_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 7)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    draw = random.Random(6)
    texts = [sentence(draw, 40) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(9)
    index, counts = alignment.count_pairs(docs, A, B)
    want = Counter(all_keys(alignment.Aligner(A, B), texts).tolist())
    assert dict(zip(index.keys.tolist(), counts.tolist(), strict=True)) == dict(want)


def test_pairs_are_bounded_by_the_vocabularies():
    tool = alignment.Aligner(A, B)
    assert 80_000 < alignment.pair_bound(tool) < 1_000_000


def test_empty_table(spark):
    assert alignment.align_corpus(odd_docs(spark, []), A, B).count() == 0


def test_every_document_is_aligned_once(spark, monkeypatch):
    asked = []
    made = alignment.aligned
    monkeypatch.setattr(alignment, "aligned", lambda docs, *paths: asked.append(1) or made(docs, *paths))
    docs = spark.createDataFrame([(1, "one text"), (2, "another text")], "doc_id long, text string")
    found = alignment.align_corpus(docs, A, B)
    # What comes back reads stored links, not the texts.
    assert asked == [1] and found.inputFiles() and found.count() == 2


def test_links_of_long_documents_are_counted(monkeypatch):
    draw = random.Random(9)
    texts = [sentence(draw, 4000), sentence(draw, 5), ""]
    tool = alignment.Aligner(A, B)
    want = alignment._align(tool, texts)
    monkeypatch.setattr(alignment, "LISTED", 100)
    monkeypatch.setattr(alignment, "SEGMENT", 400)
    got = alignment._align(alignment.Aligner(A, B), texts)
    assert (got[0] == want[0]).all() and got[2] == want[2] and got[1][1:] == want[1][1:]
    keys, times = (np.frombuffer(x, "<u8") for x in got[1][0])
    assert len(keys) < got[0][0, 2] and dict(zip(keys.tolist(), times.tolist(), strict=True)) == Counter(np.frombuffer(want[1][0][0], "<u8").tolist())

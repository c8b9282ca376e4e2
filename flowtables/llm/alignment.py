"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked token pairs.

A is a byte-level BPE vocabulary of the ``tokenizers`` library that starts words with their space, B a ``sentencepiece`` model
that puts a space before every text. Both read space + text, so their tokens cover the same bytes; tokens that end at
the same byte are linked, and the common ends cut both sequences into groups.

1. Every document is aligned once; its numbers of tokens and links, the digest of its groups and its links are stored.
2. Every task writes how often it met each pair, once per task and pair, from the stored links. A minimal perfect hash is built
   over the distinct pairs. Of two linked tokens the shorter one's bytes end the longer one's, so there are
   at most ``pair_bound`` pairs, a number that follows from the two vocabularies and not from the corpus; the keys may travel.
3. Every task adds its counts into a dense vector indexed by the hash. Vectors are summed chunk by chunk in a tree of
   fan-in ``FAN_IN``. The key stored in each slot is compared, so no foreign pair is ever counted in another's place.
4. The stored links of every document are looked up in the broadcast vector.

Neither vocabulary joins characters over a single space between two that are not white space, so texts are cut there, and
the alignment of a piece is remembered by the worker. A text whose pieces do not give its bytes back is aligned whole.

Defined results: null and empty texts, and texts whose tokens do not give space + text back (such as those with U+2581, which B
reads as a space), have no tokens, zeros and the digest ''. Strings of special tokens are plain text. Repeated rows and
ids count as often as they occur; a null id stays null; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtables.llm.common import col, stored, text_or_empty
from flowtables.llm.encoding import byte_names
from flowtables.llm.hashing import mix

# Pieces each worker remembers, twice over, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
# Bytes a writer of links holds before it hands them on.
ROW_GROUP = 16 << 20
SEGMENT = 1 << 20
FAN_IN = 16
CHUNK = 1 << 16
# Links of a document that are kept as they come; those of longer ones are counted.
LISTED = 1 << 16
# Bits a key of the hash per level; more make fewer levels.
GAMMA = 2

_between_words = re.compile(r"(?<=\S) (?=\S)")
_beside_space = re.compile(r"\s | \s")
_workers: dict[tuple[str, str], Aligner] = {}


def cuts(text: str) -> Iterator[list[str]]:
    """The pieces of a text, each without the space before it, in lists of about ``SEGMENT`` characters."""
    at = 0
    while len(text) - at > SEGMENT:
        found = _between_words.search(text, at + SEGMENT)
        if found is None:
            break
        yield _split(text[at : found.start()])
        at = found.end()
    yield _split(text[at:] if at else text)


def _split(text: str) -> list[str]:
    """At every single space between two characters that are not white space."""
    return _between_words.split(text) if text[:1] == " " or text[-1:] == " " or _beside_space.search(text) else text.split(" ")


# What is known of a piece: tokens of A, tokens of B, links (8 bytes each: id of A * 2^32 + id of B), groups as text, each closed by a semicolon.
Fact = tuple[int, int, bytes, bytes]


class Aligner:
    """Aligns pieces of text; one for each worker process, see ``aligner``."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        known = {c: byte for byte, c in byte_names.items()}
        vocabulary = {i: t for t, i in self.a.get_vocab().items()}
        names_a = [vocabulary.get(i, "") for i in range(max(vocabulary) + 1)]
        self.bytes_a = [bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t in names_a]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        # A piece of B that went on after a space would make the cuts wrong.
        self.may_cut = not any("▁" in p.lstrip("▁") for p in pieces)
        # Names of tokens as they stand inside and at the end of their side of a group.
        sizes = [len(self.bytes_a), len(self.bytes_b)]
        self.names = [f"{i}{end}".encode() for size, ends in zip(sizes, (",|", ",;"), strict=True) for end in ends for i in range(size)]
        # Bytes that A knows one by one always come back from it.
        self.lossless = self.a.normalizer is None and set(byte_names.values()) <= set(names_a)
        self.known: dict[str, Fact | None] = {}
        self.older: dict[str, Fact | None] = {}

    def facts(self, pieces: Iterable[str]) -> dict[str, Fact | None]:
        """For each of the different pieces, what is known of space + piece; None where its tokens do not give the bytes back."""
        found, fresh, known, older = {}, [], self.known, self.older
        for piece in pieces:
            fact = known.get(piece, ())
            if fact == ():
                fact = older.get(piece, ())
                if fact == ():
                    fresh.append(piece)
                    continue
                known[piece] = fact
            found[piece] = fact
        # Pieces that begin or end with white space cannot be encoded side by side.
        inner = [p for p in fresh if p and p == p.strip()] if self.may_cut else []
        made = dict(self._together(inner))
        if len(inner) < len(fresh):
            for piece in set(fresh).difference(inner):
                made.update(self._together([piece], lead=""))
        found.update(made)
        if len(self.known) + len(made) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.known.update(made)
        for piece in [p for p in made if len(p) > LONGEST_REMEMBERED]:
            del self.known[piece]
        return found

    def _together(self, pieces: list[str], lead: str = " a") -> Iterator[tuple[str, Fact | None]]:
        """Encodes pieces as one text, in which they do not touch each other; halves them to find those that do not come back."""
        if not pieces:
            return
        coded = [lead.encode(), *[(" " + p).encode() for p in pieces]]
        text, cut = b"".join(coded), np.cumsum([len(x) for x in coded])
        ids_a = self.a.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids
        ids_b = self.b.encode(text[1:].decode(), num_threads=1)
        back = self.lossless or b"".join(map(self.bytes_a.__getitem__, ids_a)) == text
        if back and b"".join(map(self.bytes_b.__getitem__, ids_b)) == text:
            flat = [np.array(ids, np.int64) for ids in (ids_a, ids_b)]
            ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, flat, strict=True)]
            until = [np.searchsorted(e, cut, side="right") for e in ends]
            if all((np.append(0, e)[u] == cut).all() for e, u in zip(ends, until, strict=True)):
                yield from zip(pieces, self._aligned(flat, ends, until), strict=True)
                return
        if len(pieces) == 1:
            yield pieces[0], None
            return
        half = len(pieces) // 2
        yield from self._together(pieces[:half], lead)
        yield from self._together(pieces[half:], lead)

    def _aligned(self, ids: list[np.ndarray], ends: list[np.ndarray], until: list[np.ndarray]) -> Iterator[Fact]:
        """One fact per piece behind the lead; ``until`` says how many tokens there are up to a piece's end."""
        common = np.intersect1d(*ends, assume_unique=True)
        last = [np.searchsorted(e, common) for e in ends]
        keys = (ids[0][last[0]].astype(np.uint64) << np.uint64(32) | ids[1][last[1]].astype(np.uint64)).astype("<u8").tobytes()
        links = np.searchsorted(last[0], until[0]).tolist()
        counts = [np.diff(u).tolist() for u in until]
        of_piece = [keys[8 * at : 8 * to] for at, to in zip(links[:-1], links[1:], strict=True)]
        names = self._in_groups(ids, last)
        ends = (until[0] + until[1]).tolist()
        return zip(*counts, of_piece, [b"".join(names[at:to]) for at, to in zip(ends[:-1], ends[1:], strict=True)], strict=True)

    def _in_groups(self, ids: list[np.ndarray], last: list[np.ndarray]) -> list[bytes]:
        """Names of all tokens, group by group, A before B; the last one of a side closes it."""
        size = len(self.bytes_a), len(self.bytes_b)
        out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side, (mine, other) in enumerate((last, last[::-1])):
            at = np.arange(len(ids[side]))
            group = np.searchsorted(mine, at)
            # B stands behind A of its own group, A behind B of the group before.
            before = other[group] + 1 if side else np.append(0, other + 1)[group]
            out[at + before] = ids[side] + size[side] * (mine[group] == at) + 2 * size[0] * side
        return list(map(self.names.__getitem__, out.tolist()))

    def pieces(self, text: str) -> Iterator[list[str]]:
        return cuts(text) if self.may_cut else iter([[text]])

    def blocks(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[int, list[str]]], Counter[str], dict[str, Fact | None]]]:
        """Texts with tokens in blocks of bounded size: [(index, its next pieces)], how often each piece occurs, and the facts of just these.

        A text that does not come back by pieces is aligned whole, and left out if it does not come back then.
        """
        held, size = [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            long = len(text) > SEGMENT
            if long and not all(all(self.facts(dict.fromkeys(part)).values()) for part in self.pieces(text)):
                parts = iter([[text]])
            else:
                parts = self.pieces(text)
            for part in parts:
                held.append((k, part))
                size += len(part)
                if size >= SEGMENT // 8:
                    yield self._block(held, texts)
                    held, size = [], 0
        if held:
            yield self._block(held, texts)

    def _block(self, held: list[tuple[int, list[str]]], texts: list[str | None]):
        pieces = Counter(chain.from_iterable(part for _, part in held))
        facts = self.facts(pieces)
        if not all(facts.values()):
            odd = {k for k, part in held if not all(map(facts.__getitem__, part))}
            facts.update(self.facts({texts[k] for k in odd}))
            held = [(k, [texts[k]] if k in odd else part) for k, part in held if k not in odd or facts[texts[k]]]
            pieces = Counter(chain.from_iterable(part for _, part in held))
            facts = {piece: facts[piece] for piece in pieces}
        return held, pieces, facts


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _workers:
        _workers.clear()
        _workers[path_a, path_b] = Aligner(path_a, path_b)
    return _workers[path_a, path_b]


def pair_bound(a: Aligner) -> int:
    """How many pairs of tokens can be linked at all: those in which one's bytes end with the other's."""
    count_a, count_b = Counter(a.bytes_a), Counter(a.bytes_b)
    longer_a = sum(count_b[t[k:]] for t in a.bytes_a for k in range(len(t)))
    return longer_a + sum(count_a[t[k:]] for t in a.bytes_b for k in range(1, len(t)))


class PerfectHash:
    """Minimal perfect hash: each of n different 64-bit keys has its own index below n.

    Keys that meet no other key in a level's bit array are placed there; the rest go to the next level. An index is the
    number of bits set before. ``find`` compares the key stored in the slot, so that foreign keys give -1.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, placed = keys, 0
        while len(left):
            size = -(-max(64, GAMMA * len(left)) // 64) * 64
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            before = placed + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self.levels.append((size, bits, before[:-1]))
            placed, left = int(before[-1]), left[~alone[at]]
        self.keys = np.empty(0, np.uint64)
        slots = self._slots(keys)
        self.keys = np.empty(len(keys), np.uint64)
        self.keys[slots] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        start = np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix(keys + start) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, before) in enumerate(self.levels):
            at = self._place(keys[left], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = (before[at >> 6] + np.bitwise_count(below))[here]
            left = left[~here]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        known = slots >= 0
        known[known] = self.keys[slots[known]] == keys[known]
        return np.where(known, slots, -1)


class _Counts:
    """Running counts of keys; as long as there are few distinct ones, so is the memory."""

    def __init__(self):
        self.keys, self.counts, self.added = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.added.append((keys, counts))
        if sum(len(k) for k, _ in self.added) > len(self.keys) + SEGMENT:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.added]])
        counts = np.concatenate([self.counts, *[c for _, c in self.added]])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts, self.added = np.zeros(len(self.keys), np.int64), []
        np.add.at(self.counts, place, counts)


ALIGNED = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_links")], ("links", pa.binary()), ("times", pa.binary()), ("groups_sha256", pa.string())])


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its numbers of tokens and links, the digest of its groups, and its links: keys of 8 bytes, id of A * 2^32 + id of B.

    ``times`` says how often each key occurs, also in 8 bytes; where it is empty, the keys stand as often as they occur.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, size = [], 0
                while at + len(texts) < batch.num_rows and len(texts) < 256 and size < SEGMENT:
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    size += len(texts[-1])
                sums, links, digests = _align(tool, texts)
                columns = [*[pa.array(sums[:, k]) for k in range(3)], *[pa.array(x, pa.binary()) for x in zip(*links, strict=True)], pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], schema=ALIGNED)
                at += len(texts)

    picked = docs.select(col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_a long, n_b long, n_links long, links binary, times binary, groups_sha256 string")


def _align(tool: Aligner, texts: list[str]) -> tuple[np.ndarray, list[tuple[bytes, bytes]], list[str]]:
    """Per text: numbers of tokens of A, of B and of links; (links, times); digest."""
    sums, digests = np.zeros((len(texts), 3), np.int64), [None] * len(texts)
    found: list[list[bytes]] = [[] for _ in texts]
    counted: dict[int, _Counts] = {}
    for held, _, facts in tool.blocks(texts):
        if not held:
            continue
        n_a, n_b, keys, groups = zip(*facts.values(), strict=True)
        rows = np.column_stack([n_a, n_b, np.fromiter(map(len, keys), np.int64, len(keys)) // 8])
        place = dict(zip(facts, range(len(facts)), strict=True))
        starts = np.cumsum([0, *[len(part) for _, part in held]])
        at = list(map(place.__getitem__, chain.from_iterable(part for _, part in held)))
        added = np.add.reduceat(rows[at], starts[:-1], axis=0)
        for (k, _), row, first, end in zip(held, added, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            text = b"".join(map(groups.__getitem__, at[first:end]))[:-1]
            if digests[k] is None:
                digests[k] = hashlib.sha256(text)
            else:
                digests[k].update(b";" + text)
            sums[k] += row
            found[k].append(b"".join(map(keys.__getitem__, at[first:end])))
            # Different links are bounded by the vocabularies, however long the text.
            if sum(map(len, found[k])) > 8 * LISTED:
                counted.setdefault(k, _Counts()).add(*_distinct(found[k]))
                found[k] = []
    links = [(b"".join(x), b"") for x in found]
    for k, total in counted.items():
        total.add(*_distinct(found[k]))
        total.merge()
        links[k] = total.keys.tobytes(), total.counts.tobytes()
    return sums, links, [d.hexdigest() if d else "" for d in digests]


def _distinct(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.frombuffer(b"".join(keys), "<u8"), return_counts=True)


def _listed(links: list[bytes], times: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of some rows one after the other, how often each occurs, and where each row starts and the last one ends."""
    starts = np.cumsum([0, *[len(x) // 8 for x in links]])
    often = np.ones(starts[-1], np.int64)
    for k, x in enumerate(times):
        if x:
            often[starts[k] : starts[k + 1]] = np.frombuffer(x, "<i8")
    return np.frombuffer(b"".join(links), "<u8"), often, starts


def count_in_tasks(stored_links: DataFrame) -> DataFrame:
    """(key, n) per task and linked pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, once = _Counts(), []
        for batch in batches:
            for links, times in zip(batch.column(0), batch.column(1), strict=True):
                links, times = links.as_py(), times.as_py()
                if times:
                    total.add(np.frombuffer(links, "<u8"), np.frombuffer(times, "<i8"))
                    continue
                once.append(links)
                if len(once) == 2048:
                    total.add(*_distinct(once))
                    once = []
        total.add(*_distinct(once))
        total.merge()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys.view(np.int64)), pa.array(total.counts)], names=["key", "n"])

    return stored_links.select("links", "times").mapInArrow(run, "key long, n long")


def tree_sum(vectors: DataFrame, tasks: int) -> DataFrame:
    """Sums the vectors (chunk, part, counts) of each chunk, ``FAN_IN`` parts at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i8") for x in table.column("counts"))
        return pa.table({"chunk": table.column("chunk")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    while tasks > 1:
        grouped = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("chunk", "part")
        vectors = grouped.applyInArrow(add, "chunk int, part int, counts binary")
        tasks = -(-tasks // FAN_IN)
    return vectors


def count_pairs(docs: DataFrame, path_a: str, path_b: str) -> tuple[PerfectHash, np.ndarray]:
    """The hash over all linked pairs of the corpus and the dense vector of their counts."""
    return _count_links(stored(aligned(docs, path_a, path_b), "aligned", row_group=ROW_GROUP), path_a, path_b)


def _count_links(stored_links: DataFrame, path_a: str, path_b: str) -> tuple[PerfectHash, np.ndarray]:
    spark = stored_links.sparkSession
    partial = stored(count_in_tasks(stored_links), "pair-counts")
    distinct = partial.select("key").distinct().toArrow().column("key").to_numpy().astype(np.int64)
    bound = pair_bound(aligner(path_a, path_b))
    if len(distinct) > bound:
        raise RuntimeError(f"{len(distinct)} linked pairs, but only {bound} are possible")
    index = PerfectHash(np.sort(distinct).view(np.uint64))
    shared = spark.sparkContext.broadcast(index)
    size = len(distinct)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        for batch in batches:
            slots = shared.value.find(batch.column(0).to_numpy().view(np.uint64))
            if (slots < 0).any():
                raise RuntimeError("a pair is not among the keys of the hash")
            np.add.at(total, slots, batch.column(1).to_numpy())
        chunks = [total[at : at + CHUNK].astype("<i8").tobytes() for at in range(0, size, CHUNK)]
        part = [TaskContext.get().partitionId()] * len(chunks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(chunks)), pa.int32()), pa.array(part, pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "part", "counts"]
        )

    # A task reads whole files, so there are at most as many tasks as files.
    vectors = partial.mapInArrow(dense, "chunk int, part int, counts binary")
    summed = tree_sum(vectors, len(partial.inputFiles())).orderBy("chunk").toArrow()
    parts = [np.frombuffer(x.as_py(), "<i8") for x in summed.column("counts")]
    return index, np.concatenate(parts) if parts else np.zeros(0, np.int64)


REPORT = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])


def align_corpus(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best are links whose pair is the most frequent one of its token of B, ties included; count_sum adds the corpus-wide counts of all
    links of the document.
    """
    once = stored(aligned(docs, path_a, path_b), "aligned", row_group=ROW_GROUP)
    index, counts = _count_links(once, path_a, path_b)
    of_b = (index.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    most = np.zeros(of_b.max() + 1 if len(of_b) else 0, np.int64)
    np.maximum.at(most, of_b, counts)
    shared = docs.sparkSession.sparkContext.broadcast((index, counts, counts == most[of_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                links, times = part.column("links").to_pylist(), part.column("times").to_pylist()
                found = _looked_up(links, times, *shared.value)
                n_links = part.column("n_links")
                columns = [part.column("n_a"), part.column("n_b"), n_links, n_links, *[pa.array(x) for x in found], part.column("groups_sha256")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], schema=REPORT)

    return once.mapInArrow(run, ", ".join(f"{n} long" for n in REPORT.names[:-1]) + ", groups_sha256 string")


def _looked_up(links: list[bytes], times: list[bytes], index: PerfectHash, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n_best and count_sum of each row."""
    keys, often, starts = _listed(links, times)
    slots = index.find(keys)
    if (slots < 0).any():
        raise RuntimeError("a pair is not among the keys of the hash")
    until = [np.append(0, np.cumsum(x[slots] * often))[starts] for x in (best, counts)]
    return np.diff(until[0]), np.diff(until[1])


def _report(tool: Aligner, texts: list[str], index: PerfectHash, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """What the two steps find of some texts, without the tables between them."""
    sums, links, digests = _align(tool, texts)
    found = _looked_up(*map(list, zip(*links, strict=True)), index, counts, best)
    return np.column_stack([sums, sums[:, 2], *found]), digests

"""Hashes of words and shingles of many texts at once, with numpy.

A word is a run of bytes that are not white space, or, with ``plain``, of letters, digits and bytes beyond ASCII; A-Z count as a-z. Hashes are 64 bits wide. Long texts are
cut at white space into segments, so working memory follows the segment, not the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

SEGMENT = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_space = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[str, np.ndarray] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IS_PLAIN_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _segment_words(data: np.ndarray, cuts: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of adjoining texts and the number of words of each; ``cuts`` are the texts' ends."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(breaks[data], out=inside[1:-1])
    border = np.zeros(len(data) + 1, bool)
    border[cuts] = True
    border[0] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], cuts])))
    return hashes, counts


def segments(text: bytes) -> Iterable[bytes]:
    at = 0
    while len(text) - at > SEGMENT:
        found = _space.search(text, at + SEGMENT)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def word_hashes(texts: list[bytes], plain: bool = False) -> list[np.ndarray]:
    """The word hashes of each text, in order."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[bytes] = []
    owners: list[int] = []
    size = 0
    breaks = _IS_PLAIN_BREAK if plain else _IS_SPACE

    def flush() -> None:
        nonlocal held, owners, size
        if held:
            data = np.frombuffer(b"".join(held), np.uint8)
            hashes, counts = _segment_words(data, np.cumsum([len(x) for x in held]), breaks)
            for owner, part in zip(owners, np.split(hashes, np.cumsum(counts)[:-1]), strict=True):
                out[owner].append(part)
        held, owners, size = [], [], 0

    for k, text in enumerate(texts):
        for part in segments(text):
            if size + len(part) > SEGMENT:
                flush()
            held.append(part)
            owners.append(k)
            size += len(part)
    flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words; fewer words make one run of all, none make an empty set."""
    if len(words) == 0:
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = mix(h * _BASE + words[k : len(words) - size + 1 + k])
    return np.unique(h)

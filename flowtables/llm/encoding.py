"""Token ids of whole texts with the ``tokenizers`` library, remembering the ids of pieces seen before.

Both public vocabularies cut texts at white space before anything else, and letters from marks, so a text is split at
places where a cut cannot change the result. Each piece is encoded by the library once per worker (as long as it is
remembered); a piece that is one run of letters goes to the library's model directly, the rest through all its steps.
A text that holds an added token of the vocabulary, such as ``<|endoftext|>``, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cached_property

REMEMBERED = 500_000
LONGEST_REMEMBERED = 64
MARKS = frozenset(",.;:!?")

_between_words = re.compile(r"(?<=\S) (?=\S)")
_over_line_end = re.compile(r"(\S+)\n(\S+)")
_workers: dict[tuple[str, str, int | None], PieceEncoder] = {}

# Fixed rule of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes for 256, 257, ...
_printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_others = [b for b in range(256) if b not in _printable]
byte_names = {b: chr(b) for b in _printable} | {b: chr(256 + k) for k, b in enumerate(_others)}


class _Pieces(dict):
    """Ids of pieces as little-endian uint32 bytes; two generations bound the memory."""

    def __init__(self, encode, most: int | None = None):
        super().__init__()
        self.encode, self.most, self.older = encode, REMEMBERED if most is None else most, {}

    def __missing__(self, piece: str):
        found = self.older.get(piece, self)
        if found is self:
            found = self.encode(piece)
            if len(piece) > LONGEST_REMEMBERED:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class PieceEncoder:
    """``how`` says where a cut is safe.

    * ``spaced``: byte-level vocabularies, in which a word starts with its space. Cut before a single space between
      two characters that are not white space.
    * ``words``: vocabularies that drop white space and case. Cut at every space, tab and line end.

    ``added`` says whether added tokens are found in texts, as the library does by itself, or are plain text.
    ``remembered`` pieces are kept twice over; it changes time and memory, not the ids.
    """

    def __init__(self, path: str, how: str, added: bool = False, remembered: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Pieces are plain text, also one that only reads like an added token in lower case.
        self.tokenizer.encode_special_tokens = True
        named = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if added and t.content]
        self.holds_added = re.compile("|".join(named)).search if named else None
        self.path, self.model, self.how = path, self.tokenizer.model, how
        self.pieces = _Pieces(self._spaced if how == "spaced" else self._word, remembered)
        self.bare = _Pieces(lambda piece: self._cut(piece, self.bare, ""), remembered)
        self.careful = _Pieces(lambda piece: self._library(" " + piece), remembered)
        self.line_end = self._library("\n")

    @cached_property
    def unchanged(self):
        """The library's tokenizer as it is, loaded when the first text with an added token comes: it is 40 MB."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """One run of letters, with its leading space if it has one."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(byte_names))]).tobytes()

    def _cut(self, piece: str, known: _Pieces, before: str) -> bytes:
        if piece.isalpha():
            return self._letters(before + piece)
        if piece[-1] in MARKS and piece[:-1].isalpha():
            return known[piece[:-1]] + self.bare[piece[-1]]
        if over := _over_line_end.fullmatch(piece):
            return known[over[1]] + self.line_end + self.bare[over[2]]
        return self._library(before + piece)

    def _spaced(self, piece: str):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None  # white space beside the cut: the text takes the careful way
        return self._cut(piece, self.pieces, " ")

    def _word(self, piece: str):
        if not piece:
            return b""
        if max(piece) <= "\xff":  # lower case is plain there, and nothing composes
            lower = piece.lower()
            if lower != piece:
                return self.pieces[lower]
            if piece.isalpha():
                return self._letters(piece)
            if piece[-1] in MARKS and piece[:-1].isalpha():
                return self.pieces[piece[:-1]] + self.pieces[piece[-1]]
        return self._library(piece)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.holds_added and self.holds_added(text):
            return array("I", self.unchanged.encode(text, add_special_tokens=False).ids).tobytes()
        if self.how == "words":
            for c in "\n\t\r":
                text = text.replace(c, " ")
            return b"".join(map(self.pieces.__getitem__, text.split(" ")))
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return self._library(first) + b"".join(map(self.pieces.__getitem__, rest))
            except TypeError:
                pass
        first, *rest = _between_words.split(text)
        return self._library(first) + b"".join(map(self.careful.__getitem__, rest))


def encoder(path: str, how: str, remembered: int | None = None) -> PieceEncoder:
    """One encoder for each worker process; it stays as long as the process."""
    key = (path, how, remembered)
    if key not in _workers:
        _workers[key] = PieceEncoder(path, how, added=True, remembered=remembered)
    return _workers[key]

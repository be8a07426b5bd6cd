"""Exact tokenizer output at memo speed: texts are cut where the tokenizer cuts anyway, and each piece is encoded once.

``Encoder`` wraps a ``tokenizers`` vocabulary file.  The ids of a text are those of ``Tokenizer.encode`` on the whole
text (``add_special_tokens=False``; a special token's string in a text gives that token, as the library has it); the tests
compare both.
"""

from __future__ import annotations

import os
import re
from array import array

import regex

#: Pieces of a generation of a worker's memo, which holds two: what the older one has is kept if it is met again
#: (results do not change).
MEMO = 500_000
#: The same of a small memo, which holds words without the signs after them: some 20 MB a worker instead of up to 200, for
#: jobs whose executors have much else to hold. It takes about 1.4 times the CPU time.
SMALL_MEMO = 50_000

_ENCODERS: dict[tuple[str, str, bool], Encoder] = {}

# The patterns by which the two vocabularies split text before merging.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# a space before a visible character starts a new piece in both
_CUT = re.compile(r"(?= \S)")
_ODD = re.compile(r"[ \n](?:\s|\Z)|\x00")
#: Signs that the patterns part from a word before them.
_SIGNS = frozenset(".,;:!?)")
# only for text in these the patterns' classes are surely those of the library, and lower case is letter by letter
_PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-\u012f\u0131-ſ]*\Z")


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Piece -> ids; a piece that is not there yet is encoded."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.pop(key, None)
        if ids is None:
            ids = self.encode(key)
        self[key] = ids
        return ids

    def turn(self) -> None:
        """Begin a new generation."""
        self.older = dict(self)
        self.clear()


class _SmallMemo(_Memo):
    """The same, but a word and a sign are put together anew each time and not kept; ``signs`` has the ids of signs."""

    signs: _Memo

    def __missing__(self, key: str) -> bytes:
        if key[-1:] in _SIGNS and key[:-1].isalpha() and _PLAIN.match(key):
            return self[key[:-1]] + self.signs[key[-1]]
        return super().__missing__(key)


class Encoder:
    """One vocabulary in one worker process. ``kind`` is "word" (white space dropped, lower case) or "byte"; ``small``:
    with a small memo."""

    def __init__(self, path: str, kind: str, small: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self.tokenizer.model.tokenize
        self.kind = kind
        self.pattern = regex.compile(_WORD_PATTERN if kind == "word" else _BYTE_PATTERN)
        self.letters = _byte_letters()
        memo, self.limit = (_SmallMemo, SMALL_MEMO) if small else (_Memo, MEMO)
        self.exact = memo(self._piece)
        # in texts cut at every blank, a key stands for a blank and itself; after "\0", for a new line and itself
        self.cut = memo(self._after_blank)
        self.exact.signs = self.cut.signs = self.exact

    def _piece(self, piece: str) -> bytes:
        # most pieces are a word, or a word and a sign: the patterns part the two, and a word is encoded once for all its signs
        if not _PLAIN.match(piece):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if piece.isalpha():
            return self._merged((piece.lower() if self.kind == "word" else piece,))
        if piece[-1:] in _SIGNS and piece[:-1].isalpha():
            return self.exact[piece[:-1]] + self.exact[piece[-1]]
        return self._merged(self.pattern.findall(piece.lower() if self.kind == "word" else piece))

    def _after_blank(self, key: str) -> bytes:
        if key[:1] == "\0":
            return self.exact["\n"] + self.exact[key[1:]]  # a line's end before a visible sign is a piece of its own
        if key[-1:] in _SIGNS and key[:-1].isalpha() and _PLAIN.match(key):
            return self.cut[key[:-1]] + self.exact[key[-1]]
        return self._piece(" " + key)

    def _merged(self, parts) -> bytes:
        """The model's ids of parts that the pattern would not cut any further."""
        ids = [t.id for p in parts for t in self.merge(p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(self.letters))]
        return array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if len(self.cut) + len(self.exact) > self.limit:
                self.cut.turn()
                self.exact.turn()
            low = text.lower()
            if any(s in low for s in self.special):
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            elif self.kind == "word":
                out.append(b"".join(map(self.exact.__getitem__, low.replace("\n", " ").split(" ") if text.isascii() else text.replace("\n", " ").split(" "))))
            elif _ODD.search(text):
                out.append(b"".join(map(self.exact.__getitem__, _CUT.split(text))))
            else:
                first, *rest = text.replace("\n", " \0").split(" ")
                lead = self.cut[first] if first[:1] == "\0" else self.exact[first]
                out.append(lead + b"".join(map(self.cut.__getitem__, rest)))
        return out


def encoder(path: str, kind: str, small: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; kept while the worker lives."""
    if (path, kind, small) not in _ENCODERS:
        _ENCODERS[path, kind, small] = Encoder(path, kind, small)
    return _ENCODERS[path, kind, small]

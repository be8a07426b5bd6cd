"""Exact token counts under a unigram vocabulary, without making the tokens.

Count-only Viterbi: an Aho-Corasick automaton enumerates the vocabulary's matches in a text; dynamic programming over
their ends carries the best score and the number of pieces on the best path.  Ties follow the tokenizer: ends are reached
from the left, and a later path must be strictly better, so of equal paths the one whose last piece starts first stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fianchetto.llm.common import steps, texts_of

SPACE = "▁"  # stands for a blank in the vocabulary
#: What an unknown character scores below the vocabulary's least score.
UNKNOWN_PENALTY = 10.0
#: Words that a worker's memo holds, and the longest that goes there; results do not depend on either.
MEMO, MEMO_LENGTH = 500_000, 64
COUNT_SCHEMA = "doc_id long, n_tokens long, score double"

_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Pieces and scores of one vocabulary; ``count(text)`` gives (pieces, score) of the best path.

    A character that no piece covers counts ``unknown_bytes`` pieces if True, one for each of its UTF-8 bytes (byte
    fallback), else a run of such characters counts one.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            if piece:
                scores.setdefault(piece, score)
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.empty = not scores
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        # text may be cut before a blank that follows another character if no piece crosses such a place, and if sums
        # of scores are exact in any order
        self.cuts = byte_fallback and all(s == int(s) for s in scores.values()) and not any(
            SPACE in p.lstrip(SPACE) for p in scores)
        self.memo: dict[str, tuple[int, float]] = {}

    def path(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path over the whole text."""
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        start, count, is_unknown = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        at = 0

        def unknown(i: int) -> None:
            """No piece ends at i that covers its character alone: the unknown character is one more way to get there."""
            s = best[i - 1] + self.unknown
            if best[i] is None or s > best[i] or (s == best[i] and i - 1 < start[i]):
                best[i], start[i], is_unknown[i] = s, i - 1, True
                if self.byte_fallback:
                    count[i] = count[i - 1] + len(text[i - 1].encode())
                else:
                    count[i] = count[i - 1] + (not is_unknown[i - 1])

        single = False
        matches = () if self.empty else self.automaton.iter(text)
        for last, (length, score) in matches:
            i = last + 1
            while at < i - 1:  # ends passed without (further) matches
                at += 1
                if not single:
                    unknown(at)
                single = False
            j = i - length
            s = best[j] + score
            if length == 1:
                single = True
            if best[i] is None or s > best[i] or (s == best[i] and j < start[i]):
                best[i], start[i], count[i], is_unknown[i] = s, j, count[j] + 1, False
        while at < n:
            at += 1
            if not single:
                unknown(at)
            single = False
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """Pieces and score of ``SPACE`` + text with blanks replaced; an empty text has none."""
        if not text:
            return 0, 0.0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self.path(marked)
        pieces, total = 0, 0.0
        memo, words = self.memo, marked.split(SPACE)
        blanks = 0  # a word takes all blanks before it along
        for w in words[1:]:
            blanks += 1
            if not w:
                continue
            unit = SPACE * blanks + w
            blanks = 0
            got = memo.get(unit)
            if got is None:
                got = self.path(unit)
                if len(unit) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[unit] = got
            pieces += got[0]
            total += got[1]
        if blanks:
            n, s = self.path(SPACE * blanks)
            pieces, total = pieces + n, total + s
        return pieces, total


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]


def counter(path: str) -> Counter:
    """The worker's counter for a model file; kept while the worker lives."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(load_pieces(path))
    return _COUNTERS[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in steps(texts):
                got = [c.count(t) for t in texts[lo:hi]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())],
                    names=["doc_id", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and the best path's score of every whole text, row by row and without a shuffle.

    ``model`` is a sentencepiece file whose ordinary pieces and scores are taken as the unigram vocabulary; blanks become
    its blank sign, one is put before the text, and characters outside the vocabulary count one piece per byte.  A null
    or empty text counts 0 with score 0.  Rows stay as they are, repeated ones and null doc_ids too.  Other columns are
    not read.
    """
    texts = texts_of(docs)
    return texts.mapInArrow(_count(model), COUNT_SCHEMA)

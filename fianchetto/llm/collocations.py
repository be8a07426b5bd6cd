"""Phrase collocation mining: an FM-index per shard over word ids, summed across shards.

Texts are cut into shards of bounded size, one language each, and kept as word ids.  Words are counted over all shards;
a word below the least count is in no candidate and becomes a boundary.  Then, for one length of phrases after the other,
each shard is indexed by the Burrows-Wheeler transforms of its ids and of its ids in reverse, and phrases are enumerated
level by level: a phrase is an interval in both, a step to the right reads its next words off the reversed transform, a
step to the left its former words off the other, and the ranks of the symbols give the longer phrases' intervals.  Counts
add up over the shards.

Rotations are sorted by as many symbols as the longest phrase has: intervals of phrases up to that length, and the ranks
that lead to them, are those of the full index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fianchetto.llm.common import materialize, small_batches

#: Bytes of text in a shard, about; only a piece that is longer by itself makes a larger one.
SHARD_BYTES = 8 << 20
ROWS_PER_BATCH = 200_000

# What ends a piece, what parts words, and which letters have a lower case here.
_ENDS, _BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_CLEAN = bytes(0x0A if b in _ENDS else 0x20 if b in _BLANKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_END = b"\xff"  # occurs in no UTF-8 text
_SHARDS = "lang string, n long, words array<binary>, counts array<int>, ids binary"


def cuts(clean: bytes, limit: int):
    """Parts of a cleaned text of at most ``limit`` bytes, cut where a piece ends; a longer piece stays whole."""
    lo = 0
    while len(clean) - lo > limit:
        at = clean.rfind(b"\n", lo, lo + limit)
        if at < 0:
            at = clean.find(b"\n", lo)
        if at < 0:
            break
        yield clean[lo:at]
        lo = at + 1
    yield clean[lo:]


def _shard(lang: str, parts: list[bytes]) -> tuple | None:
    tokens = (b"\n".join(parts) + b"\n").replace(b"\n", b" " + _END + b" ").split()
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    ids, words = coded.indices.to_numpy(), coded.dictionary
    count = np.bincount(ids, minlength=len(words)).astype(np.int32)
    end = words.index(pa.scalar(_END, pa.binary())).as_py()
    n = len(ids) - int(count[end])
    if not n:
        return None
    # a boundary is -1; the four bytes of the ids by planes, which compress better
    ids = np.where(ids == end, -1, ids).astype("<i4")
    planes = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes()
    return lang, n, words, count, zstandard.ZstdCompressor(3).compress(planes)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _encode(limit: int):
    def rows(shard):
        lang, n, words, count, blob = shard
        one = pa.array([0, len(words)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.int64()), pa.ListArray.from_arrays(one, words),
                                           pa.ListArray.from_arrays(one, pa.array(count)), pa.array([blob], pa.binary())], ["lang", "n", "words", "counts", "ids"])

    def run(batches):
        held, size = {}, {}
        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in cuts(raw.translate(_CLEAN), limit):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part) + 1
                    full = lang if size[lang] >= limit else max(size, key=size.get) if sum(size.values()) >= 3 * limit else None
                    if full is not None:  # of very many languages, the largest goes first
                        shard = _shard(full, held.pop(full))
                        del size[full]
                        if shard:
                            yield rows(shard)
        for lang, parts in held.items():
            shard = _shard(lang, parts)
            if shard:
                yield rows(shard)

    return run


# --- the index of a shard -----------------------------------------------------------


class Side:
    """The transform of a cyclic text and what ranks its symbols: ``extend`` steps from intervals to longer ones."""

    def __init__(self, text: np.ndarray, depth: int, symbols: int):
        n = len(text)
        if symbols**depth < 1 << 62:
            key = np.zeros(n, np.int64)
            for i in range(depth):
                key *= symbols
                key += np.roll(text, -i)
            order = np.argsort(key, kind="stable")
            del key
        else:
            order = np.lexsort([np.roll(text, -i) for i in reversed(range(depth))])
        self.n, self.bwt = n, text[order - 1].astype(np.int64)
        # occurrences by (symbol, row): the place of (c, row) is C[c] + rank of c before the row
        self.occurrences = np.sort(self.bwt * n + np.arange(n))

    def extend(self, lo: np.ndarray, size: np.ndarray, other: np.ndarray):
        """All extensions of the intervals [lo, lo+size) by one symbol, boundaries left out.

        Returns (which interval, symbol, count, its lo here, its lo on the other side); ``other`` are the intervals' lo there.
        """
        ends = np.cumsum(size)
        which = np.repeat(np.arange(len(lo)), size)
        symbol = self.bwt[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - lo, size)]
        span = int(self.bwt.max()) + 1 if self.n else 1
        pairs, count = np.unique(which * span + symbol, return_counts=True)
        which, symbol = pairs // span, pairs % span
        before = np.cumsum(count) - count  # within an interval, smaller symbols come first
        first = np.searchsorted(which, np.arange(len(lo)))
        smaller = before - (before[first[which]] if len(which) else 0)
        words = symbol > 0
        which, symbol, count, smaller = which[words], symbol[words], count[words], smaller[words]
        return which, symbol, count, np.searchsorted(self.occurrences, symbol * self.n + lo[which]), other[which] + smaller


def phrases(text: np.ndarray, depth: int):
    """All phrases of 2 to ``depth`` symbols in a text whose boundaries are 0: one (symbols, counts) a length.

    Steps go to the right and to the left in turn; ``symbols`` has a row for each phrase.
    """
    text = np.concatenate((text, [0]))
    text = text[(text > 0) | (np.concatenate(([1], text[:-1])) > 0)]  # boundaries in a row are one
    symbols = int(text.max()) + 1
    count = np.bincount(text, minlength=symbols)
    lo = (np.cumsum(count) - count)[1:]
    found, size, other = np.arange(1, symbols)[:, None], count[1:], lo
    forward, backward = Side(text, depth, symbols), Side(text[::-1], depth, symbols)
    for step in range(1, depth):
        if step % 2:  # to the right: next symbols stand in the transform of the reversed text
            which, symbol, size, other, lo = backward.extend(other, size, lo)
            found = np.column_stack((found[which], symbol))
        else:
            which, symbol, size, lo, other = forward.extend(lo, size, other)
            found = np.column_stack((symbol, found[which]))
        yield found, size


def _enumerate(depth: int):
    """The phrases of ``depth`` words of each shard, with their counts."""

    def run(batches):
        for batch in batches:
            for blob, local, word in zip(*(batch.column(c) for c in ("ids", "local", "word")), strict=True):
                ids = unpacked(blob.as_py())
                local, word = (x.values.to_numpy(zero_copy_only=False) for x in (local, word))
                known = np.zeros(max(int(ids.max()), int(local.max())) + 2, np.int64)  # the last place is a boundary's, -1
                known[local] = np.arange(1, len(local) + 1)
                names = np.concatenate(([-1], word))
                *_, (found, count) = phrases(known[ids], depth)
                for at in range(0, len(count), ROWS_PER_BATCH):
                    part = slice(at, at + ROWS_PER_BATCH)
                    yield pa.RecordBatch.from_arrays([*(pa.array(names[found[part, i]]) for i in range(depth)), pa.array(count[part], pa.int64())],
                                                     [*(f"g{i + 1}" for i in range(depth)), "a"])

    return run


# --- all shards ---------------------------------------------------------------------


def phrase_counts(docs: DataFrame, least: int = 10, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples, totals) of documents by language, from the shards' indexes.

    words: id, lang, word, f; pairs and triples: g1, g2(, g3), the ids of their words, and a; all with counts of at least
    ``least``.  totals: lang and n, all occurrences of words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shards = materialize(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
                         .mapInArrow(_encode(shard_bytes), _SHARDS).withColumn("shard", F.monotonically_increasing_id()), "phrase-shards")
    held = shards.select("shard", "lang", F.posexplode("words").alias("local", "word"), "counts").withColumn("c", F.col("counts")[F.col("local")]).drop("counts")
    held = held.where(F.col("word") != F.lit(_END))
    words = materialize(held.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
                        .select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"), "phrase-words")
    # each shard's own common words: as many as it has, whatever the number of all
    own = held.join(words, ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("local", "id")).alias("k"))
    joined = materialize(shards.select("shard", "ids").join(own, "shard").select("ids", F.col("k.local").alias("local"), F.col("k.id").alias("word")),
                         "phrase-ids")

    def sums(depth: int) -> DataFrame:
        # a shard's phrases are distinct already: they go straight to the sums, no table of them is kept on the way
        keys = [f"g{i + 1}" for i in range(depth)]
        found = joined.mapInArrow(_enumerate(depth), ", ".join(f"{k} long" for k in [*keys, "a"])).repartition(*keys)
        return materialize(found.groupBy(*keys).agg(F.sum("a").alias("a")).where(F.col("a") >= least), f"phrases-{depth}")

    # one length after the other: the disks hold the phrases of one at a time
    return words, sums(2), sums(3), shards.groupBy("lang").agg(F.sum("n").alias("n"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)) in whole numbers of up to 38 digits: exact for counts below 10^16."""
    a, left, right = (c.cast("decimal(16,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def mine_collocations(docs: DataFrame, least: int = 10, top: int = 2000, share: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The ``top`` phrases of two or three words of each language by score: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r the parts of the cut that scores lowest (floor(10^6 a^2 / (l r)); of equal ones, after the
    fewest words), n all words of the language.  Phrases lie within pieces (parted by ``.,;:!?`` and line ends), overlapping
    occurrences count, only A-Z lose their case.  A phrase below ``least`` is none; one inside a longer one that has at
    least ``share`` percent of its count is left out.  Order: score and a descending, phrase ascending by its bytes.

    A null lang is ``und``, a null text empty; repeated rows count again; a language without a phrase has no rows.  Other
    columns and doc_id are not read.
    """
    words, two, three, totals = phrase_counts(docs, least, shard_bytes)
    w = [words.select(F.col("id").alias(f"g{i}"), F.col("f").alias(f"f{i}"), F.col("word").cast("string").alias(f"w{i}")) for i in (1, 2, 3)]
    # a phrase of two inside one of three with so much of its count goes
    over = (three.select("g1", "g2", "a").unionByName(three.select(F.col("g2").alias("g1"), F.col("g3").alias("g2"), "a"))
            .groupBy("g1", "g2").agg(F.max("a").alias("longer")))
    short = (two.join(over, ["g1", "g2"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
             .join(w[0], "g1").join(w[1], "g2")
             .select("g1", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
             .withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"))))
    head = two.withColumnRenamed("a", "head")
    tail = two.select(F.col("g1").alias("g2"), F.col("g2").alias("g3"), F.col("a").alias("tail"))
    parts = three.join(head, ["g1", "g2"]).join(tail, ["g2", "g3"]).join(w[0], "g1").join(w[1].drop("f2"), "g2").join(w[2], "g3")
    parts = parts.withColumn("s1", _score(F.col("a"), F.col("f1"), F.col("tail"))).withColumn("s2", _score(F.col("a"), F.col("head"), F.col("f3")))
    first = F.col("s1") <= F.col("s2")
    long = parts.select("g1", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("head")).alias("l"),
                        F.when(first, F.col("tail")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    named = short.unionByName(long).join(words.select(F.col("id").alias("g1"), "lang"), "g1")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

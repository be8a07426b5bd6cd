"""Benchmark decontamination by greedy string tiling.

Documents and test items meet by an equi-join of the seeds they share: hashes of runs of ``least`` words.  A document's
seeds first pass a sieve of fixed size, a bit for every seed that some item has, so most never leave their task.  For each
pair that the join finds, the longest common run of words that is not yet covered becomes a tile, again and again, until
none of at least ``least`` words is left.  The share of the item's words under tiles is its coverage, whatever the order of
the passages.

Texts are told apart by their md5: a document that occurs many times is searched once.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fianchetto.llm.common import materialize, runs, small_batches, steps, texts_of, word_hashes

LEAST_WORDS = 5
#: Share of an item's words that must lie under tiles.
COVERAGE = 0.5
#: Bits of the sieve, as a power of two: 2 MB in each worker, whatever the number of items.
SIEVE_BITS = 24
#: Rows that the items of one document are dealt over, each with its text.
ITEM_PARTS = 16
#: Shared places of a document and an item up to which their runs are listed; beyond (texts of few words, again and
#: again), runs are found item word by item word in memory that grows with the document alone. Results are the same.
LISTED_PLACES = 1 << 20
FOUND_SCHEMA = "key string, item long, item_words int, matched_words int, tiles int, coverage double"


#: Characters beyond ASCII that are no letters or digits (of ASCII, ``word_hashes`` knows them).
_SIGNS = re.compile(r"[^\x00-\x7F\w]")


def normal_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (letters and digits) of texts, and each text's first word."""
    return word_hashes([(t if t.isascii() else _SIGNS.sub(" ", t)).lower().encode() for t in texts], letters_only=True)


def _seeds(h: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Seed hash at every word; windows that cross a text's end are made unlike any other (0)."""
    s = np.zeros(len(h), np.uint64)
    w = runs(h, least)
    s[: len(w)] = w
    for_end = np.repeat(first[1:], np.diff(first))
    s[np.arange(len(h)) + least > for_end] = 0
    return s


def tile(doc_at: np.ndarray, item_at: np.ndarray, least: int) -> tuple[int, int]:
    """(words under tiles, tiles) of one document and one item, from the places of their shared seeds.

    Seeds one after the other on a diagonal are one common run.  The longest run that still is uncovered is marked
    first; equal ones from the item's start, then the document's.  What marks leave of a run is a shorter run.
    """
    order = np.lexsort((item_at, doc_at - item_at))
    d, i = doc_at[order], item_at[order]
    head = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(d - i) != 0)])
    length = np.diff(np.r_[head, len(i)]) + least - 1
    heap = [(-n, x, y) for n, x, y in zip(length.tolist(), i[head].tolist(), d[head].tolist(), strict=True)]
    heapq.heapify(heap)
    in_item, in_doc = set(), set()
    words = tiles = 0
    while heap:
        n, x, y = heapq.heappop(heap)
        free = [x + k not in in_item and y + k not in in_doc for k in range(-n)]
        if all(free):
            in_item.update(range(x, x - n))
            in_doc.update(range(y, y - n))
            words, tiles = words - n, tiles + 1
            continue
        k = 0
        while k < -n:  # the parts that are still free
            if not free[k]:
                k += 1
                continue
            end = k
            while end < -n and free[end]:
                end += 1
            if end - k >= least:
                heapq.heappush(heap, (k - end, x + k, y + k))
            k = end
    return words, tiles


def tile_repeats(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int]:
    """The same of two word sequences, by the definition: each round looks for the longest run that nothing covers yet."""
    doc, item = doc.copy(), item.copy()
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    words = tiles = 0
    while True:
        best, run = (0, 0, 0), np.zeros(len(doc), np.int64)
        for x in range(len(item)):
            run = np.where((doc == item[x]) & free_doc & free_item[x], np.r_[0, run[:-1]] + 1, 0)
            n = int(run.max(initial=0))
            if n > best[0] or n == best[0] > 0 and x - n + 1 < best[1]:
                best = (n, x - n + 1, int(np.argmax(run)) - n + 1)
        n, x, y = best
        if n < least:
            return words, tiles
        free_item[x : x + n] = False
        free_doc[y : y + n] = False
        words, tiles = words + n, tiles + 1


def tile_pair(doc: np.ndarray, doc_seeds: np.ndarray, item: np.ndarray, item_seeds: np.ndarray, least: int) -> tuple[int, int]:
    """(words under tiles, tiles) of a document's and an item's words; seeds of 0 are none."""
    order = np.argsort(item_seeds, kind="stable")
    lo, hi = (np.searchsorted(item_seeds[order], doc_seeds, side) for side in ("left", "right"))
    n = np.where(doc_seeds != 0, hi - lo, 0)
    if not n.any():
        return 0, 0
    if n.sum() > LISTED_PLACES:
        return tile_repeats(doc, item, least)
    at = np.flatnonzero(n)
    n, lo = n[at], lo[at]
    before = np.cumsum(n) - n
    return tile(np.repeat(at, n), order[np.repeat(lo - before, n) + np.arange(n.sum())], least)


# --- in Spark -----------------------------------------------------------------------


def _item_rows(least: int):
    """Task body: (item, text) -> (item, words, seeds), the hashes of both as bytes; items too short for a seed are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in steps(texts):
                h, first = normal_words(texts[lo:hi])
                seeds = _seeds(h, first, least)
                cut = [slice(x, y) for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([h[c].tobytes() for c in cut], pa.binary()),
                                                  pa.array([np.unique(seeds[c][seeds[c] != 0]).view(np.int64) for c in cut], pa.list_(pa.int64()))],
                                                 names=["item", "words", "seeds"])

    return run


def _sieved(least: int, sieve):
    """Task body: (doc_id, key, text) -> those with the distinct seeds that pass the sieve, if any do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in steps(texts):
                h, first = normal_words(texts[lo:hi])
                seeds = _seeds(h, first, least)
                place = seeds >> np.uint64(64 - SIEVE_BITS)
                at = np.flatnonzero((seeds != 0) & ((bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0))
                cut = np.searchsorted(at, first)
                rows = [i for i in range(hi - lo) if cut[i] < cut[i + 1]]
                own = [np.unique(seeds[at[cut[i] : cut[i + 1]]]).view(np.int64) for i in rows]
                part = b.slice(lo, hi - lo).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "key", "text", "seeds"])

    return run


def _tiles(least: int, coverage: float):
    """Task body: (key, text, items, their words) -> the items that reach the coverage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, items, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, first = normal_words([text])
                seeds = _seeds(h, first, least)
                for item, raw in zip(items, words, strict=True):
                    own = np.frombuffer(raw, np.uint64)
                    n, tiles = tile_pair(h, seeds, own, _seeds(own, np.array([0, len(own)]), least), least)
                    if tiles and n >= coverage * len(own):
                        rows.append((key, item, len(own), n, tiles, n / len(own)))
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["key", "item", "item_words", "matched_words", "tiles", "coverage"])

    return run


def _sieve(seeds: DataFrame) -> np.ndarray:
    """The bits of all items' seeds. At most a row for 64 of them reaches the driver, 2 ** (SIEVE_BITS - 6) in all."""
    place = F.shiftrightunsigned("seed", 64 - SIEVE_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    found = seeds.select((place / 64).cast("int").alias("i"), bit.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    out[found.column("i").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def _search(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, hits, items): which texts (by key) hold which items, the documents that came through the sieve, the items."""
    spark = docs.sparkSession
    small_batches(spark)
    asked = materialize(benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").distinct()
                        .select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    items = materialize(asked.select("item", "text").mapInArrow(_item_rows(least), "item long, words binary, seeds array<long>"), "item-words")
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    sieve = spark.sparkContext.broadcast(_sieve(seeds))
    keyed = texts_of(docs).select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"), "text")
    hits = materialize(keyed.mapInArrow(_sieved(least, sieve), "doc_id long, key string, text string, seeds array<long>"), "hits")
    pairs = (hits.select("key", F.explode("seeds").alias("seed")).join(seeds, "seed").select("key", "item").distinct())
    # the text is that of any document with the key
    listed = (pairs.join(items.select("item", "words"), "item").withColumn("part", F.pmod(F.xxhash64("item", "key"), F.lit(ITEM_PARTS)))
              .groupBy("key", "part").agg(F.collect_list(F.struct("item", "words")).alias("i")))
    texts = hits.select("key", "text").join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    found = (texts.join(listed, "key").select("key", "text", F.col("i.item").alias("items"), F.col("i.words").alias("words"))
             .mapInArrow(_tiles(least, coverage), FOUND_SCHEMA))
    return found, hits, asked


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_WORDS) -> DataFrame:
    """Pairs of a document and a test item whose words lie under common tiles for at least ``coverage``.

    Returns doc_id, item_id, item_words, matched_words, tiles, coverage; documents that hold no item have no row.  Words
    are runs of letters and digits (of Unicode), lower-cased; signs do not matter.  Whole texts are searched.  Null and empty texts on
    either side hold nothing; an item of fewer than ``least`` words can't be found.  Repeated documents give repeated
    rows, null ids stay null; rows of the benchmark that are equal count once.  Other columns are not read.
    """
    found, hits, asked = _search(docs, benchmark, coverage, least)
    return (hits.select("doc_id", "key").join(found, "key").join(asked.select("item", "item_id"), "item")
            .select("doc_id", "item_id", "item_words", "matched_words", "tiles", "coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the rows whose text holds a test item (see ``find_contamination``); all columns stay."""
    found, _, _ = _search(docs, benchmark, coverage, least)
    keys = materialize(found.select(F.col("key").alias("_text_key")).distinct(), "contaminated")
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.join(keys, key == F.col("_text_key"), "left_anti")

"""Helpers that the operators of this subpackage share: scratch tables, batches, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fianchetto.session import ensure_checkpoint_dir, small_batches

#: Characters that one vectorised step of a Python worker holds at most (but for a single longer text).
CHARS_PER_STEP = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII signs: what parts words where only letters and digits make them up.
_NO_LETTER = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


#: Spark removes the shuffle files of a query as soon as it is done.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the write's shuffles go with it, not when the driver next collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a null text as an empty one, for Python workers in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5; rows with 0 are held out of every fit. A null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


def steps(texts: list[str], limit: int = CHARS_PER_STEP) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into index ranges of at most ``limit`` characters (one text at least)."""
    lo = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, elementwise on uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHARS_PER_STEP * 2)
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes], letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and each text's first word index.

    With ``letters_only``, ASCII signs part words, too.

    Returns (hashes, offsets) with len(offsets) = len(texts) + 1.  A polynomial hash by prefix sums, mixed at the
    end: equal words have equal hashes on every machine.
    """
    raw = b"\n".join(texts) + b"\n"
    a = np.frombuffer(raw, np.uint8)
    space = (_NO_LETTER if letters_only else _SPACE)[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    p, inverse = _powers(len(a) + 1)
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p[: len(a)], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    return h, np.searchsorted(start, first)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive word hashes (windows may cross texts: the caller cuts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    return mix(out)

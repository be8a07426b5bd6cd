"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles.  Its sketch has one register for each bucket of hashes: the leading
zeros and some mantissa bits of the bucket's least hash.  Documents whose registers agree in a whole band are candidates;
the share of equal registers, less the equal ones to be expected by collision, estimates their similarity; what may reach
the threshold is confirmed on the full sets.

Equal sets are one class from the start, and only a class's first document goes on.  A band's bucket is not turned into
all its pairs: its members are compared with its first one (the pivot).  Members that are linked to the pivot are in one
component already; a link that this leaves out has an end that is not linked to the pivot.  So the members of such
pivots are compared once more, block against block inside tasks, and only what connects a block's components leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fianchetto.llm.common import materialize, mix, runs, steps, texts_of, word_hashes
from fianchetto.llm.components import components

#: Registers of a sketch (a power of two) and the bits of a register: leading zeros (6) and mantissa.
REGISTERS, MANTISSA_BITS = 256, 10
EMPTY = 0xFFFF
#: Registers of a band. A link at similarity 0.85 shares none of the 42 bands with probability 2e-9.
BAND = 6
BANDS = REGISTERS // BAND
#: Sets below this size leave many registers empty: their bands also tell sizes apart.
SPARSE = 256
#: Standard errors by which an estimate may miss the threshold and still be confirmed.
MARGIN = 6.0
#: Members of a pivot that one block holds.
BLOCK = 512
_REST = 64 - (REGISTERS.bit_length() - 1)
# Fixed value: expected share of chance collisions of two registers (published constant of the sketch).
_COLLISIONS = 0.169919487159739093975315012348630288992889

SKETCH_SCHEMA = "doc_id long, hash long, n_shingles long, set_key binary, registers binary"


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for lo, hi in steps(texts):
        h, first = word_hashes([t.encode().lower() for t in texts[lo:hi]])
        s = runs(h, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                own = np.sort(s[a : b - size + 1])
                out.append(own[np.r_[True, own[1:] != own[:-1]]])
            elif b > a:
                out.append(runs(h[a:b], b - a) ^ np.uint64(b - a))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sorted sets of hashes, a row each: the least hash of each bucket, as leading zeros and mantissa bits."""
    out = np.full(len(sets) * REGISTERS, EMPTY, np.uint16)
    if sets and (n := np.array([len(s) for s in sets])).any():
        h = np.concatenate(sets)
        slot = np.repeat(np.arange(len(sets)) * REGISTERS, n) + (h >> np.uint64(_REST)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        m, e = np.frexp((h[head] & np.uint64((1 << _REST) - 1)).astype(np.float64))
        out[slot[head]] = ((_REST - e) << MANTISSA_BITS) | np.floor(np.maximum(2 * m - 1, 0) * (1 << MANTISSA_BITS)).astype(np.int64)
    return out.reshape(len(sets), REGISTERS)


def band_keys(registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, used): a key for every band of every sketch, and whether the band has a register in use."""
    r = registers[:, : BANDS * BAND].reshape(-1, BANDS, BAND)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2])
    for i in range(BAND):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + r[:, :, i].astype(np.uint64))
    return h, (r != EMPTY).any(axis=2)


def band_places(registers: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of every band of a sketch, from 0: by registers in use, most first, then by key."""
    filled = (registers[:, : BANDS * BAND].reshape(-1, BANDS, BAND) != EMPTY).sum(axis=2)
    places = np.empty(keys.shape, np.int64)
    np.put_along_axis(places, np.lexsort((keys, -filled), axis=1), np.arange(BANDS)[None, :], axis=1)
    return places


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of sketches row by row, less expected collisions, and the registers that it rests on."""
    used = ((x != EMPTY) | (y != EMPTY)).sum(axis=1)
    equal = ((x == y) & (x != EMPTY)).sum(axis=1)
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    chance = _COLLISIONS * REGISTERS / 2.0**MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(equal - chance, 0) / np.maximum(used, 1), used


def set_key(s: np.ndarray) -> bytes | None:
    """What equal sets share; None for the empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in steps(texts):
                sets = shingle_sets(texts[lo:hi], size)
                keys = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                     pa.array([r.tobytes() for r in sketches(sets)], pa.binary())], names=["doc_id", "hash", "n_shingles", "set_key", "registers"])

    return run


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _band_rows(percent: int):
    """Task body: (band key, document) of the bands in use that a link needs.

    Two sets can only be linked if their sizes are within ``percent`` of each other.  Sets of fewer than SPARSE shingles
    get keys for their size class and the next (one of which two such sets share), others plain keys; those near SPARSE
    get both.

    A shingle that only one of two sets has changes one band at most, and a set of n shingles and one linked to it differ by
    n * (100 - percent) / percent shingles at most.  So of a set's bands in any order that both share, the first that is
    not changed comes after that many at most: these and one more are enough for every link.  Bands with the most
    registers in use come first, as they tell most; bands of one shingle, which a common line brings, come last.
    """
    step = np.log(100 / percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                ids, n = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                registers = _registers(part.column(2))
                keys, used = band_keys(registers)
                used &= band_places(registers, keys) <= (n * (100 - percent) // percent)[:, None]
                level = np.floor(np.log(n) / step).astype(np.uint64)
                kinds = [(n >= SPARSE * percent // 100, np.zeros(len(n), np.uint64))]
                kinds += [(n * percent <= SPARSE * 100, level + np.uint64(k)) for k in (1, 2)]
                for rows, tag in kinds:
                    on = used & rows[:, None]
                    key = mix(keys ^ mix(tag)[:, None])[on]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.broadcast_to(ids[:, None], on.shape)[on])], names=["key", "doc_id"])

    return run


def _near(percent: int):
    """Task body: pairs with both sketches -> whether the estimate leaves a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = percent / 100
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                n, m = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                j, used = estimate(_registers(part.column(4)), _registers(part.column(5)), n, m)
                near = (j >= t - MARGIN * np.sqrt(t * (1 - t) / np.maximum(used, 1))) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near)], names=["m", "p", "near"])

    return run


def _sets(size: int):
    """Task body: (class, its set's key, text) -> (class, shingles) where the text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo, hi in steps(texts):
                sets = shingle_sets(texts[lo:hi], size)
                own = [i for i, s in enumerate(sets) if set_key(s) == keys[lo + i]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(own, pa.int64())),
                                                  pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["c", "shingles"])

    return run


def _linked(percent: int):
    """Task body: pairs with both full sets -> whether they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0
                out.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], names=["m", "p", "linked"])

    return run


def block_links(ids: list[int], sets: list[np.ndarray], linked: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the components of a cell's members, by their full sets; pairs whose ends are both linked to
    the pivot are left out (they are connected by it)."""
    n = np.array([len(s) for s in sets], np.int64)
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = np.flatnonzero(np.bincount(where, minlength=len(values)) > 1)  # what one member holds alone adds nothing
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    at = place[where]
    common = np.zeros((len(sets), len(sets)), np.float32)
    by_column = np.argsort(at, kind="stable")
    at, row = at[by_column], row[by_column]
    for lo in range(0, len(shared), 4096):
        a, b = np.searchsorted(at, (lo, lo + 4096))
        has = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
        has[row[a:b], at[a:b] - lo] = 1
        common += has @ has.T
    common = common.astype(np.int64)
    joined = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    joined &= ~(linked[:, None] & linked[None, :])
    np.fill_diagonal(joined, False)
    some = np.flatnonzero(joined.any(axis=1))
    if not len(some):
        return []
    joined = joined[np.ix_(some, some)] | np.eye(len(some), dtype=bool)
    least = np.arange(len(some))
    while True:
        lower = np.where(joined, least[None, :], len(some)).min(axis=1)
        if (lower == least).all():
            break
        least = lower
    return [(ids[some[i]], ids[some[j]]) for i, j in enumerate(least.tolist()) if i != j]


def _cells(percent: int):
    """Task body: rows (p, i, j, m, linked, shingles) with the rows of a cell one after the other -> connecting links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close():
            links = []
            if len(held) > 1 and not all(x[1] for x in held):
                links = block_links([x[0] for x in held], [np.frombuffer(x[2], np.uint64) for x in held], np.array([x[1] for x in held]), percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for p, i, j, m, linked, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (p, i, j) != key:
                    if len(held) > 1:
                        yield close()
                    held.clear()
                    key = (p, i, j)
                held.append((m, linked, shingles))
        if len(held) > 1:
            yield close()

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    A document's set: the distinct runs of ``size`` words ``[^\\x20\\x09-\\x0D]+`` of its whole text with A-Z in lower
    case; a shorter text's words are one shingle.  Two documents are linked if 100 * intersection >= percent * union, by
    the full sets.  component_id is the least doc_id that links lead to, kept says whether it is the document's own.

    Null, empty and blank texts have no shingles and are linked with nothing.  A null doc_id has no component, is linked
    with nothing and is kept.  Rows are documents of their own: of rows that share a doc_id, each is linked by its own
    text.  An empty table gives an empty result.  Other columns are not read.
    """
    texts = texts_of(docs).select("doc_id", F.xxhash64("text").alias("hash"), "text")
    all_ = materialize(texts.mapInArrow(_sketch(size), SKETCH_SCHEMA), "sketches")
    known = all_.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("set_key").agg(F.min(F.struct("doc_id", "hash", "n_shingles", "registers")).alias("s"))
                          .select(F.monotonically_increasing_id().alias("c"), "set_key", "s.*"), "classes")

    # below this size, sets that differ cannot be linked
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))
    firsts = classes.where(F.col("n_shingles") >= least).select(F.col("c").alias("doc_id"), "n_shingles", "registers")  # from here on, classes
    bands = firsts.mapInArrow(_band_rows(percent), "key long, doc_id long")
    pivots = bands.groupBy("key").agg(F.min("doc_id").alias("p"), F.count("doc_id").alias("c")).where("c > 1").select("key", "p")
    pairs = bands.join(pivots, "key").where("doc_id <> p").select(F.col("doc_id").alias("m"), "p").distinct()

    of_m = firsts.select(F.col("doc_id").alias("m"), F.col("n_shingles").alias("n_m"), F.col("registers").alias("r_m"))
    of_p = firsts.select(F.col("doc_id").alias("p"), F.col("n_shingles").alias("n_p"), F.col("registers").alias("r_p"))
    sketched = pairs.join(of_m, "m").join(of_p, "p").select("m", "p", "n_m", "n_p", "r_m", "r_p")
    judged = materialize(sketched.mapInArrow(_near(percent), "m long, p long, near boolean"), "pairs")

    groups = judged.groupBy("p").agg(F.count("m").alias("members")).where("members > 1")
    many = materialize(judged.join(groups, "p"), "many")
    near = judged.where("near")
    wanted = near.select("m").unionByName(near.select(F.col("p").alias("m"))).unionByName(many.select("m")).distinct()
    # the texts of the classes' first documents: equal doc_ids alone do not meet
    asked = classes.select("c", "doc_id", "hash", "set_key").join(wanted.withColumnRenamed("m", "c"), "c", "left_semi")
    sets = materialize(texts.join(asked, ["doc_id", "hash"]).select("c", "set_key", "text").mapInArrow(_sets(size), "c long, shingles binary")
                       .dropDuplicates(["c"]).withColumnRenamed("c", "doc_id"), "sets")
    set_m, set_p = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s_{c}")) for c in ("m", "p"))
    verified = near.join(set_m, "m").join(set_p, "p").select("m", "p", "s_m", "s_p").mapInArrow(_linked(percent), "m long, p long, linked boolean")
    linked = materialize(verified.where("linked").select("m", "p").distinct(), "linked")

    # members of a pivot that is not linked to all of them: block against block
    member = many.join(linked.withColumn("linked", F.lit(True)), ["m", "p"], "left").select("p", "m", "members", F.coalesce("linked", F.lit(False)).alias("linked"))
    member = materialize(member, "members")
    open_ = member.where("NOT linked").select("p").distinct()
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("m", "p"), blocks).cast("int")
    spread = (member.join(open_, "p", "left_semi").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .select("p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "m", "linked"))
    cells = spread.join(set_m, "m").select("p", "i", "j", "m", "linked", F.col("s_m").alias("shingles"))
    more = cells.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(_cells(percent), "a long, b long")

    joined = components(linked.select(F.col("m").alias("a"), F.col("p").alias("b")).unionByName(more))
    of_class = classes.select("c", "set_key", "doc_id").join(joined, F.col("c") == F.col("node"), "left").withColumn("component", F.coalesce("component", "c"))
    named = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.join(named, "component").select("set_key", "component_id")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return (all_.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
            .select("doc_id", "n_shingles", own_id.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))

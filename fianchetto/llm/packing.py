"""Best-fit packing of documents into sequences of fixed length by hierarchical residual packing.

Each task packs the pieces it holds by best fit, longest first, and emits the nearly full bins.  Underfull bins become
items of the next round: they meet others in fewer, again bounded, tasks and are packed by best fit once more, until one
task holds all that remain or a round neither merges anything nor gets by with fewer tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fianchetto.llm.common import materialize, steps, texts_of

PIECE_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
MEMBER = pa.struct([*PIECE_FIELDS, ("offset", pa.int32())])
BIN_SCHEMA = "fill int, done boolean, bin long, members array<struct<doc_id long, piece int, start long, length int, ids_crc32 long, offset int>>"
#: Underfull bins that one task of a merge round takes, and how many tasks of a round meet in one of the next.
BINS_PER_TASK = 50_000
FAN_IN = 8
#: A bin with at most this share of the capacity free is emitted at once.
NEARLY_FULL = 1 / 64


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids: whole if it fits, else pieces of the capacity, the first with what is over."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return [first] * bool(first) + [capacity] * (n // capacity)


def _pieces(path: str, kind: str, end_id: int, capacity: int, small_memo: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fianchetto.llm.encoding import encoder

        enc, end = encoder(path, kind, small_memo), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in steps(texts):
                rows = []
                for doc, ids in zip(doc_ids[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    ids, at = ids + end, 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        rows.append((doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                        at += n
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, PIECE_FIELDS, strict=True)],
                                                 names=[f for f, _ in PIECE_FIELDS])

    return run


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item, items in the given order: the fullest bin that still takes it, else a new one.

    Bins are kept by free room; a bit mask of the rooms in use gives the smallest that suffices.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = n = 0
    out = []
    for s in sizes:
        fits = used >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        out.append(b)
        left = room - s
        if left:
            rooms[left].append(b)
            used |= 1 << left
    return out


def _pack(round_: int, capacity: int, first: bool):
    """Task body of one round: items (pieces, or underfull bins with their members) -> bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        base = (round_ << 56) | (TaskContext.get().partitionId() << 32)
        size = table.column("length" if first else "fill").combine_chunks().to_numpy()
        order = np.argsort(-size, kind="stable")
        bins = np.array(best_fit(size[order].tolist(), capacity))
        by_bin = np.argsort(bins, kind="stable")  # items of a bin together, in the order they were placed
        order, bins = order[by_bin], bins[by_bin]
        head = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        before = np.cumsum(size[order]) - size[order]
        shift = before - np.repeat(before[head], np.diff(np.r_[head, len(bins)]))  # an item's place in its bin
        taken = table.take(pa.array(order))
        if first:
            cols = [taken.column(f).combine_chunks() for f, _ in PIECE_FIELDS] + [pa.array(shift, pa.int32())]
            counts = np.ones(len(order), np.int64)
        else:
            lists = taken.column("members").combine_chunks()
            inner, counts = lists.flatten(), np.asarray(lists.value_lengths())
            moved = np.asarray(inner.field("offset")) + np.repeat(shift, counts)
            cols = [inner.field(f) for f, _ in PIECE_FIELDS] + [pa.array(moved, pa.int32())]
        members = pa.StructArray.from_arrays(cols, fields=list(MEMBER))
        ends = np.r_[0, np.cumsum(counts)]
        offsets = ends[np.r_[head, len(order)]]
        fill = np.add.reduceat(size[order], head).astype(np.int32)
        done = fill >= capacity - int(capacity * NEARLY_FULL)
        out = pa.Table.from_arrays(
            [pa.array(fill, pa.int32()), pa.array(done), pa.array(base + np.arange(len(head)), pa.int64()),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members)],
            names=["fill", "done", "bin", "members"],
        )
        yield from out.to_batches(max_chunksize=4096)

    return run


def merge_bins(level: DataFrame, capacity: int) -> DataFrame:
    """Rounds of best fit over underfull bins, from the written bins of the first round to the last; all done bins.

    Every round is written to the shared folder: its done bins are part of the result, the others are the next round's
    items.  Only numbers of bins reach the driver.
    """
    rounds, k, items, before = [], 0, None, 0
    while True:
        rest = level.where("NOT done")
        bins, left, tasks = level.agg(F.count("bin"), F.count_if(~F.col("done")), F.count_distinct(F.shiftright("bin", 32))).first()
        merged = items is None or bins < items or tasks < before
        if tasks <= 1 or left <= 1 or not merged:
            rounds.append(level)
            break
        rounds.append(level.where("done"))
        items, before, k = left, tasks, k + 1
        todo = rest.repartition(max(-(-left // BINS_PER_TASK), -(-tasks // FAN_IN)))
        level = materialize(todo.mapInArrow(_pack(k, capacity, False), BIN_SCHEMA), f"bins{k}")
    return reduce(DataFrame.unionByName, rounds)


def pack_documents(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, capacity: int = 2048,
                   small_memo: bool = False) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece (from 0), start (its document's ids before it), length, ids_crc32, sequence_id,
    offset (its place in the sequence; a sequence's pieces leave no gap from 0 on).  Documents that fit stay whole; longer
    ones are cut into pieces of ``capacity``, the first with what is over.  A null text counts as empty: one piece, the
    end id alone.  Null or repeated doc_ids are separate documents all the same.  An empty table has no pieces.  ``docs``
    needs doc_id and text; other columns are not read.  ``small_memo`` spares memory for CPU time (``encoding.SMALL_MEMO``);
    the rows are the same.
    """
    pieces, pack = _pieces(vocabulary, kind, end_id, capacity, small_memo), _pack(0, capacity, True)
    first = texts_of(docs).mapInArrow(lambda batches: pack(pieces(batches)), BIN_SCHEMA)  # one worker a task does both
    bins = merge_bins(materialize(first, "bins0"), capacity)
    rows = bins.select("bin", F.explode("members").alias("m"))
    return rows.select("m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"), "m.ids_crc32",
                       F.col("bin").alias("sequence_id"), F.col("m.offset").cast("long").alias("offset"))

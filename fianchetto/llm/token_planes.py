"""Token ids as a binary table of bit- or byte-plane shuffled, zstandard-compressed chunks with a chunk index.

Layout of a written folder (all parts are ordinary Parquet tables, committed by Spark, so a lost executor or a repeated
task leaves no half-written file, and any store that Spark reaches will do):

- ``chunks``: one row per chunk of ``chunk_ids`` ids (the last of a shard may be shorter): shard, chunk, n_ids,
  plane_bytes (compressed size of each plane, the lowest first), payload (the planes' zstandard frames, one after the
  other), and which documents' ids it holds: doc_row (the document's place in its shard), doc_id, doc_ids (how many of
  its ids are in this chunk), doc_begins, doc_ends.
- ``index``: the chunk index without payload: shard, chunk, first_id (ids of all chunks before it), n_ids, plane_bytes.
  The ids of all documents, in ascending doc_id order, form one sequence; ``first_id`` is a position in it.

A shard is what one task writes: a range of doc_ids.  A plane holds one bit (or one byte) of every id of the chunk; the
upper ones are all zero for a small vocabulary and compress to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fianchetto.llm.common import scratch, steps, texts_of

CHUNK_IDS = 1 << 16
CHUNK_SCHEMA = (
    "shard int, chunk int, n_ids int, plane_bytes array<int>, payload binary, doc_row array<long>, doc_id array<long>, "
    "doc_ids array<int>, doc_begins array<boolean>, doc_ends array<boolean>"
)


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of uint32 ids: 4 byte planes, or 32 bit planes (eight ids to a byte), lowest first."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if planes == "byte":
        return [r.tobytes() for r in rows]
    return [np.packbits((r >> b) & 1).tobytes() for r in rows for b in range(8)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """Ids back from their planes (4: byte planes; 32: bit planes)."""
    if len(planes) == 4:
        rows = [np.frombuffer(p, np.uint8) for p in planes]
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes]
        rows = [sum(bits[8 * r + b] << b for b in range(8)) for r in range(4)]
    return np.stack(rows, axis=1).astype(np.uint8, copy=False).reshape(-1).view("<u4")


def pack_chunk(ids: np.ndarray, planes: str, level: int) -> tuple[list[int], bytes]:
    import zstandard

    frames = [zstandard.ZstdCompressor(level=level).compress(p) for p in to_planes(ids, planes)]
    return [len(f) for f in frames], b"".join(frames)


def unpack_chunk(payload: bytes, plane_bytes, n: int) -> np.ndarray:
    import zstandard

    ends = np.cumsum(plane_bytes)
    d = zstandard.ZstdDecompressor()
    return from_planes([d.decompress(payload[e - s : e]) for s, e in zip(plane_bytes, ends, strict=True)], n)


def _write_shard(path: str, kind: str, end_id: int, planes: str, level: int, chunk_ids: int):
    """Task body: texts in doc_id order -> chunk rows.  Holds one batch of texts and the ids of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from fianchetto.llm.encoding import encoder

        enc, shard = encoder(path, kind), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held, docs, chunk, row = bytearray(), [], 0, 0

        def emit():
            nonlocal chunk
            ids = np.frombuffer(bytes(held), "<u4")
            sizes, payload = pack_chunk(ids, planes, level)
            cols = [list(c) for c in zip(*docs, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(ids)], pa.int32()),
                 pa.array([sizes], pa.list_(pa.int32())), pa.array([payload], pa.binary()),
                 *(pa.array([c], pa.list_(t)) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()), strict=True))],
                names=["shard", "chunk", "n_ids", "plane_bytes", "payload", "doc_row", "doc_id", "doc_ids", "doc_begins", "doc_ends"],
            )
            chunk += 1
            held.clear()
            docs.clear()
            return out

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in steps(texts):
                for doc, ids in zip(doc_ids[lo:hi], enc.encode(texts[lo:hi]), strict=True):
                    ids, at = ids + end, 0
                    while at < len(ids):
                        part = ids[at : at + 4 * chunk_ids - len(held)]
                        held += part
                        docs.append((row, doc, len(part) // 4, at == 0, at + len(part) == len(ids)))
                        at += len(part)
                        if len(held) == 4 * chunk_ids:
                            yield emit()
                    row += 1
        if held:
            yield emit()

    return run


def write_token_planes(docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 2, out: str | None = None,
                       planes: str = "byte", level: int = 3, chunk_ids: int = CHUNK_IDS) -> str:
    """Encode every whole text, append ``end_id`` to each, and write the ids in ascending doc_id order; returns the folder.

    ``docs`` needs doc_id and text; other columns, whatever their names, are not read.  A null text is encoded as an
    empty one (only the end id).  A null doc_id sorts first.  Repeated doc_ids stay separate documents, in the order of
    their texts' hashes; rows that are equal throughout are interchangeable.  An empty table makes empty tables.

    One range shuffle of the texts; each task then encodes, shuffles planes and compresses what it holds, chunk by chunk.
    """
    spark, out = docs.sparkSession, out or scratch(docs.sparkSession, "planes")
    ordered = (texts_of(docs).withColumn("_tie", F.xxhash64("text")).repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie"))
    chunks = ordered.select("doc_id", "text").mapInArrow(_write_shard(vocabulary, kind, end_id, planes, level, chunk_ids), CHUNK_SCHEMA)
    chunks.write.option("compression", "uncompressed").parquet(f"{out}/chunks")
    written = spark.read.schema(CHUNK_SCHEMA).parquet(f"{out}/chunks")
    _with_starts(written.select("shard", "chunk", "n_ids", "plane_bytes")).write.parquet(f"{out}/index")
    return out


def _with_starts(chunks: DataFrame) -> DataFrame:
    """Chunk index rows with first_id: shard totals (one small row a shard) are summed up in shard order, then the
    chunks of each shard."""
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (chunks.join(totals, "shard")
            .select("shard", "chunk", (F.col("_base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first_id"),
                    "n_ids", "plane_bytes"))


def read_ids(spark: SparkSession, path: str, first: int, count: int) -> np.ndarray:
    """Random access by the chunk index: ids [first, first + count) of the sequence (a small range, to the caller)."""
    hit = (spark.read.parquet(f"{path}/index").where((F.col("first_id") < first + count) & (F.col("first_id") + F.col("n_ids") > first))
           .select("shard", "chunk", "first_id"))
    rows = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks").join(hit, ["shard", "chunk"]).orderBy("first_id").collect()
    if not rows:
        return np.empty(0, "<u4")
    ids = np.concatenate([unpack_chunk(r.payload, r.plane_bytes, r.n_ids) for r in rows])
    return ids[first - rows[0].first_id :][:count]


PIECE_SCHEMA = "shard int, chunk int, doc_row long, doc_id long, skipped int, n int, crc long"


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: each chunk's documents, or parts of documents, with the crc32 of their ids."""
    for batch in batches:
        for r in batch.to_pylist():
            raw = unpack_chunk(r["payload"], r["plane_bytes"], r["n_ids"]).tobytes()
            ends = np.cumsum(r["doc_ids"]) * 4
            starts = ends - np.array(r["doc_ids"]) * 4
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["chunk"]] * n, pa.int32()), pa.array(r["doc_row"], pa.int64()),
                 pa.array(r["doc_id"], pa.int64()), pa.array(starts // 4, pa.int32()), pa.array(r["doc_ids"], pa.int32()),
                 pa.array([zlib.crc32(raw[s:e]) for s, e in zip(starts, ends, strict=True)], pa.int64())],
                names=["shard", "chunk", "doc_row", "doc_id", "skipped", "n", "crc"],
            )


def _crc_step(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def crc32_join(left: int, right: int, right_bytes: int) -> int:
    """crc32 of two byte strings put together, from their crc32s and the second's length."""
    zero = [0xEDB88320] + [1 << i for i in range(31)]  # what one zero bit does to a crc
    for _ in range(3):
        zero = [_crc_step(zero, r) for r in zero]  # one zero byte
    while right_bytes:
        if right_bytes & 1:
            left = _crc_step(zero, left)
        zero = [_crc_step(zero, r) for r in zero]
        right_bytes >>= 1
    return left ^ right


def _join_crcs(parts):
    """Checksums of documents that chunk borders cut, from their parts in order."""
    import pandas as pd

    out = []
    for p in parts:
        crc = int(p[0]["crc"]) if p is not None else 0
        for x in p[1:] if p is not None else []:
            crc = crc32_join(crc, int(x["crc"]), 4 * int(x["n"]))
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Chunks are read wherever they lie; a document cut by chunk borders is joined from its parts' checksums, so no task
    holds more than a chunk.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    index = spark.read.schema("shard int, chunk int, first_id long, n_ids int, plane_bytes array<int>").parquet(f"{path}/index")
    pieces = chunks.mapInArrow(_read_chunks, PIECE_SCHEMA).join(index.select("shard", "chunk", "first_id"), ["shard", "chunk"])
    one = F.struct("chunk", (F.col("first_id") + F.col("skipped")).alias("start"), "n", "crc")
    docs = pieces.groupBy("shard", "doc_row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(one)).alias("p"))
    whole = F.when(F.size("p") == 1, F.col("p")[0]["crc"])
    return docs.select(
        "doc_id", F.col("p")[0]["start"].alias("start"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_tokens"),
        F.coalesce(whole, F.pandas_udf(_join_crcs, "long")(F.when(F.size("p") > 1, F.col("p")))).alias("ids_crc32"),
    )

"""Sharding by fixed virtual slots.

A record is hashed into one of thousands of slots, for good; bytes and rows are added up per slot; a versioned table maps
slots to shards.  Rebalancing edits that map: whole slots move, records keep their slots.  A map is a Parquet folder with one
partition ``version=N`` per version, so every earlier state can be read.

The slot of a record is a hash of its key columns.  Only a key whose equal rows together outweigh an average slot is
split: its rows, which nothing tells apart, are dealt over all slots.

Only tables of at most one row per slot (a parameter, thousands) reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fianchetto.llm.common import materialize, scratch

SLOTS = 4096
#: Rebalancing stops once the heaviest and the lightest shard differ by this share of a mean shard.
TOLERANCE = 0.0005


def record_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def with_slots(rows: DataFrame, key: str = "key", row: str = "row", slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Add ``virtual_slot`` to rows (``key`` long, ``row`` a number of its own, ``size`` long); also returns the split keys.

    A key with several rows is split if they hold more bytes than an average slot: there are fewer such keys than slots.
    """
    home = F.pmod(F.col(key), F.lit(slots)).cast("int")
    per_slot = rows.groupBy(home.alias("home")).agg(F.sum("size").alias("bytes"))
    mean = (per_slot.agg(F.sum("bytes")).first()[0] or 0) / slots
    heavy_slots = per_slot.where(F.col("bytes") > mean).select("home")  # at most one row a slot
    heavy = (rows.withColumn("home", home).join(F.broadcast(heavy_slots), "home", "left_semi")
             .groupBy(key).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
             .where((F.col("bytes") > mean) & (F.col("n") > 1)).select(key, F.lit(True).alias("_split")))
    heavy = materialize(heavy, "split-keys")
    dealt = F.pmod(F.xxhash64(key, row), F.lit(slots)).cast("int")
    return rows.join(F.broadcast(heavy), key, "left").withColumn("virtual_slot", F.when(F.col("_split"), dealt).otherwise(home)).drop("_split"), heavy


def slot_totals(slotted: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot."""
    size, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.virtual_slot], count[r.virtual_slot] = r.b, r.n
    return size, count


# --- the map ------------------------------------------------------------------------


def first_map(slots: int, shards: int) -> np.ndarray:
    """Slots dealt to the shards in turn, before anything is known of their sizes."""
    return np.arange(slots) % shards


def balanced(shard_of: np.ndarray, weight: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """The map edited until its shards weigh nearly the same, one move or exchange of slots at a time.

    Each edit goes between the heaviest and the lightest shard: the slot, or the exchange of two slots, that comes nearest to
    halving their difference.  A heaviest shard that no edit relieves (one record may outweigh a shard) is left, and the rest go on.
    """
    out = shard_of.copy()
    load = np.bincount(out, weight, shards).astype(np.int64)
    closed = np.zeros(shards, bool)
    for _ in range(8 * len(out)):
        if closed.all():
            break
        high = int(np.flatnonzero(~closed)[np.argmax(load[~closed])])
        low = int(np.argmin(load))
        gap = int(load[high] - load[low])
        if gap <= max(1, tolerance * load.mean()):
            break
        mine, other = np.flatnonzero(out == high), np.flatnonzero(out == low)
        order = other[np.argsort(weight[other], kind="stable")]
        best = (gap / 2, -1, -1)  # how far from half the gap; an edit must be nearer than none at all
        if len(mine):
            a = int(np.argmin(np.abs(weight[mine] - gap / 2)))
            best = min(best, (abs(weight[mine][a] - gap / 2), int(mine[a]), -1))
        if len(mine) and len(order) and best[0] > gap / 8:
            at = np.searchsorted(weight[order], weight[mine] - gap / 2)
            for side in (np.clip(at - 1, 0, len(order) - 1), np.clip(at, 0, len(order) - 1)):
                off = np.abs(weight[mine] - weight[order[side]] - gap / 2)
                a = int(np.argmin(off))
                best = min(best, (off[a], int(mine[a]), int(order[side[a]])))
        if best[1] < 0:
            closed[high] = True
            continue
        out[best[1]] = low
        moved = int(weight[best[1]])
        if best[2] >= 0:
            out[best[2]] = high
            moved -= int(weight[best[2]])
        load[high] -= moved
        load[low] += moved
    return out


def grown(shard_of: np.ndarray, weight: np.ndarray, shards: int) -> np.ndarray:
    """The map with one more shard, which takes slots from the heaviest shards until it has its share; no other slot moves."""
    out = shard_of.copy()
    load = np.bincount(out, weight, shards + 1).astype(np.int64)
    target = load.sum() / (shards + 1)
    while load[shards] < target:
        high = int(np.argmax(load[:shards]))
        mine = np.flatnonzero((out == high) & (weight > 0))
        fits = mine[weight[mine] <= target - load[shards]]
        if not len(fits):
            break
        wanted = min(load[high] - target, target - load[shards])
        a = int(fits[np.argmin(np.abs(weight[fits] - wanted))])
        out[a] = shards
        load[high] -= weight[a]
        load[shards] += weight[a]
    return out


def write_map(spark: SparkSession, path: str, shard_of: np.ndarray, version: int) -> None:
    """Add a version to the map. A version is written once: a repeated call fails rather than changing it."""
    rows = [(s, int(x)) for s, x in enumerate(shard_of)]
    spark.createDataFrame(rows, "slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, np.ndarray]:
    """A version of the map (the latest, if none is named): (version, shard of every slot)."""
    maps = spark.read.schema("slot int, shard int, version int").parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    rows = maps.where(F.col("version") == version).collect()
    out = np.zeros(len(rows), np.int64)
    for r in rows:
        out[r.slot] = r.shard
    return version, out


def edit_map(spark: SparkSession, path: str, weight: np.ndarray, shards: int) -> tuple[int, np.ndarray]:
    """Rebalance the latest map of ``path`` (version 1 is written first where there is none) and write the edited one.

    Returns the version in force and its map; a map that is balanced already gets no new version.
    """
    try:
        version, now = read_map(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        version, now = 1, first_map(len(weight), shards)
        write_map(spark, path, now, version)
    edited = balanced(now, weight, shards)
    if (edited != now).any():
        version += 1
        write_map(spark, path, edited, version)
    return version, edited


def moved_slots(spark: SparkSession, path: str, old: int, new: int) -> DataFrame:
    """The slots whose shard differs between two versions of a map: slot, old_shard, new_shard."""
    maps = spark.read.schema("slot int, shard int, version int").parquet(path)
    a = maps.where(F.col("version") == old).select("slot", F.col("shard").alias("old_shard"))
    b = maps.where(F.col("version") == new).select("slot", F.col("shard").alias("new_shard"))
    return a.join(b, "slot", "full").where(~F.col("old_shard").eqNullSafe(F.col("new_shard")))


# --- placing records ----------------------------------------------------------------


def place(slotted: DataFrame, shard_of: np.ndarray, count: np.ndarray, version: int, order: list[str]) -> DataFrame:
    """Add ``shard``, ``map_version`` and ``slot``: the record's place in its shard, from 0 without gaps.

    A shard's slots follow each other; a slot's first place is the number of rows in the slots before it, and the rows of a
    slot are numbered by a window over that slot alone.
    """
    first = np.zeros(len(shard_of), np.int64)
    by_shard = np.lexsort((np.arange(len(shard_of)), shard_of))
    run = np.cumsum(count[by_shard]) - count[by_shard]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(shard_of[by_shard])) + 1))
    base = np.repeat(run[starts], np.diff(np.concatenate((starts, [len(shard_of)]))))
    first[by_shard] = run - base
    rows = [(s, int(shard_of[s]), int(first[s])) for s in range(len(shard_of))]
    where = slotted.sparkSession.createDataFrame(rows, "virtual_slot int, shard int, first long")
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*order))
    return (slotted.join(F.broadcast(where), "virtual_slot")
            .withColumn("slot", F.col("first") + inside - 1).withColumn("map_version", F.lit(version)).drop("first"))


def shard_records(docs: DataFrame, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Put all documents into ``shards`` shards of nearly equal bytes (the law ``bytes``).

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 (unsigned, UTF-8), law, shard, slot (the place in the
    shard, from 0 without gaps), grown_shard (null: under this law a further shard is filled by ``grown``), virtual_slot and
    map_version.  ``path`` takes the map's versions: 1 before anything is known, 2 rebalanced; if it holds a map already, its
    latest version is the one that is edited.

    The key of a record is its doc_id and text: null ids, empty and null texts, repeated ids and repeated rows are records as
    all others.  A null text has size 1 and the crc of no bytes.  No rows give no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialize(docs.select(F.col("doc_id").cast("long"), record_size(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                                   F.xxhash64("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("row")), "records")
    slotted, _ = with_slots(rows, slots=slots)
    size, count = slot_totals(slotted, slots)
    version, edited = edit_map(spark, path or scratch(spark, "slot-map"), size, shards)
    placed = place(slotted, edited, count, version, ["doc_id", "text_crc32", "row"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                         "virtual_slot", "map_version")


def write_shards(docs: DataFrame, out: str, shards: int = 8, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Write the documents themselves, all their columns, into folders ``shard=K`` of ``out``; returns what was written.

    A shard's rows come from as many tasks as its slots fall to, and its files are sorted by slot, so that moving a slot
    later on reads only the row groups that hold it.  The columns ``shard`` and ``virtual_slot`` replace any of that name.
    """
    spark = docs.sparkSession
    whole = F.struct(*[F.col(c) for c in docs.columns if c not in ("shard", "virtual_slot")]).alias("whole")
    rows = materialize(docs.select(whole, record_size(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key"),
                                   F.monotonically_increasing_id().alias("row")), "whole-records")
    slotted, _ = with_slots(rows, slots=slots)
    size, _ = slot_totals(slotted, slots)
    _, edited = edit_map(spark, path or scratch(spark, "slot-map"), size, shards)
    where = spark.createDataFrame([(s, int(x)) for s, x in enumerate(edited)], "virtual_slot int, shard int")
    placed = slotted.join(F.broadcast(where), "virtual_slot").select("whole.*", "virtual_slot", "shard")
    (placed.repartition("virtual_slot").sortWithinPartitions("shard", "virtual_slot").write.partitionBy("shard").parquet(out))
    return spark.read.parquet(out)

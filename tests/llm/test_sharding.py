"""Sharding by virtual slots against plain counting, and the edits of the map."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from fianchetto.llm import sharding
from fianchetto.llm.common import scratch
from fianchetto.llm.queries import op12_sharding
from tests.conftest import SMALL


def test_every_record_once_in_gapless_places_and_near_equal_bytes(spark):
    got = op12_sharding(spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    load = dict.fromkeys(range(8), 0)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
    for shard in load:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8


def test_odd_rows_and_an_empty_table(spark, odd, empty):
    got = sharding.shard_records(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert all(r.size == 1 and r.text_crc32 == 0 for r in got if r.doc_id in (1, 2, 13))
    assert sharding.shard_records(empty).collect() == []


def test_equal_rows_that_are_a_third_of_the_table_are_dealt_over_all_shards(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.col("id").cast("string")).alias("text"))
    got = sharding.shard_records(rows).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("last"),
                                                            F.countDistinct("slot").alias("places")).collect()
    assert len(got) == 8 and all(r.places == r.n == r.last + 1 for r in got)
    assert max(r.b for r in got) - min(r.b for r in got) <= 0.01 * sum(r.b for r in got) / 8
    _, heavy = sharding.with_slots(rows.select(F.xxhash64("doc_id", "text").alias("key"), F.lit(1).alias("size"), F.col("doc_id").alias("row")))
    assert heavy.count() == 1


def test_a_slot_depends_on_the_record_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    part = {(r.doc_id, r.virtual_slot) for r in sharding.shard_records(docs.where("doc_id % 2 = 0")).collect()}
    assert part <= {(r.doc_id, r.virtual_slot) for r in sharding.shard_records(docs).collect()}


def test_rebalancing_moves_whole_slots_until_shards_are_near_equal():
    rng = np.random.default_rng(1)
    for weight in (rng.pareto(1.5, 4096) * 1000, rng.integers(0, 5, 4096), np.zeros(4096), np.r_[1e6, np.ones(4095)], np.r_[np.zeros(4000), rng.integers(1, 9000, 96)]):
        weight = weight.astype(np.int64)
        before = sharding.first_map(4096, 8)
        after = sharding.balanced(before, weight, 8)
        load = np.bincount(after, weight, 8)
        rest = np.sort(load)[:-1] if weight.max() > weight.sum() / 8 else load
        assert after.shape == before.shape and set(after) <= set(range(8))
        assert rest.max() - rest.min() <= max(1, 0.01 * rest.mean())
        assert (sharding.balanced(after, weight, 8) == after).all()  # nothing to edit


def test_a_further_shard_takes_slots_only_into_itself():
    rng = np.random.default_rng(2)
    weight = rng.integers(1, 1000, 4096)
    before = sharding.balanced(sharding.first_map(4096, 8), weight, 8)
    after = sharding.grown(before, weight, 8)
    assert set(after[after != before]) == {8}
    load = np.bincount(after, weight, 9)
    assert load.max() - load.min() <= 0.02 * load.mean()


def test_versions_of_a_map_stay_readable(spark):
    path = scratch(spark, "test-map")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert {r.map_version for r in sharding.shard_records(docs, path=path).collect()} == {2}
    version, now = sharding.read_map(spark, path)
    assert version == 2 and (sharding.read_map(spark, path, 1)[1] == sharding.first_map(sharding.SLOTS, 8)).all()
    # the same records again: the map in force needs no edit
    assert {r.map_version for r in sharding.shard_records(docs, path=path).collect()} == {2}
    moved = sharding.moved_slots(spark, path, 1, 2).collect()
    assert len(moved) == (now != sharding.first_map(sharding.SLOTS, 8)).sum() > 0
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6).where("doc_id % 5 = 0"))
    placed = {r.doc_id: (r.virtual_slot, r.shard) for r in sharding.shard_records(more, path=path).collect()}
    version, later = sharding.read_map(spark, path)
    for r in sharding.shard_records(docs, path=scratch(spark, "test-map")).collect():
        assert placed[r.doc_id][0] == r.virtual_slot and placed[r.doc_id][1] == later[r.virtual_slot]


def test_documents_written_in_shards(spark, odd):
    got = sharding.write_shards(odd, scratch(spark, "test-shards"))
    assert sorted(map(str, got.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert {"shard", "virtual_slot"} <= set(got.columns)

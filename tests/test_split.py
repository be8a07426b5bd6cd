from pyspark.sql import functions as F

from fianchetto.operators import split


def _games(spark, n, parts):
    return spark.range(n).select(F.col("id").alias("game_id")).repartition(parts)


def test_exact_sizes_disjoint_complete(spark):
    s = split.split_exact(_games(spark, 1003, 5))
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": int(1003 * 0.8), "val": int(1003 * 0.1),
                      "test": 1003 - int(1003 * 0.8) - int(1003 * 0.1)}
    assert s.select("game_id").distinct().count() == 1003
    assert sorted(r.rk for r in s.select("rk").collect()) == list(range(1003))


def test_independent_of_partitioning(spark):
    a = {r.game_id: (r.split, r.rk) for r in split.split_exact(_games(spark, 500, 1)).collect()}
    b = {r.game_id: (r.split, r.rk) for r in split.split_exact(_games(spark, 500, 7)).collect()}
    assert a == b


def test_sample_and_head(spark):
    s = split.split_exact(_games(spark, 1000, 3))
    smp = split.sample_exact(s, {"train": 50, "val": 10, "test": 500})
    counts = {r.split: r["count"] for r in smp.groupBy("split").count().collect()}
    assert counts == {"train": 50, "val": 10, "test": 100}
    head = split.head_subset(s, {"train": 5, "val": 3})
    assert head.count() == 8


def test_batches(spark):
    s = split.split_exact(_games(spark, 100, 3))
    b = split.assign_batches(s, epochs=(0, 1), batch_size=32)
    tr = b.where("split = 'train'")
    assert tr.groupBy("epoch", "batch_id").count().where("count > 32").count() == 0
    e0 = {r.game_id: (r.batch_id, r.batch_pos) for r in tr.where("epoch = 0").collect()}
    e1 = {r.game_id: (r.batch_id, r.batch_pos) for r in tr.where("epoch = 1").collect()}
    assert e0 != e1 and set(e0) == set(e1)


def test_materialized_split_equals_lazy(spark):
    g = _games(spark, 300, 3)
    a = {r.game_id: (r.split, r.rk) for r in split.split_exact(g).collect()}
    b = {r.game_id: (r.split, r.rk) for r in split.split_exact(g, materialize=True).collect()}
    assert a == b

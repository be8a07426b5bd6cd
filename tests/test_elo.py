from pyspark.sql import functions as F

from fianchetto.functions.elo import denormalize_elo, normalize_elo, to_float32


def test_round_trip_and_clamp(spark):
    df = spark.createDataFrame([(1600,), (500,), (3000,)], "e int")
    r = df.select(normalize_elo("e").alias("n")).collect()
    assert abs(r[0].n - 0.4) < 1e-12 and r[1].n == 0.0 and r[2].n == 1.0
    back = df.select(denormalize_elo(normalize_elo("e")).alias("b")).collect()
    assert abs(back[0].b - 1600) < 2


def test_float32_effect(spark):
    df = spark.range(800, 2801).select(F.col("id").cast("int").alias("e"))
    n = normalize_elo("e")
    r = df.select(F.sum((denormalize_elo(to_float32(n)) != F.col("e")).cast("int")).alias("f32"),
                  F.sum((denormalize_elo(n) != F.col("e")).cast("int")).alias("f64")).collect()[0]
    assert (r.f32, r.f64) == (985, 0)

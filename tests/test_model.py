import tempfile

from pyspark.sql import functions as F

from fianchetto.operators import model as M
from fianchetto.operators import split


def _train(spark):
    df = spark.range(200).select(F.col("id").alias("game_id"),
                                 (F.col("id") % 17).cast("double").alias("x"))
    return df.withColumn("target", F.lit(0.1) + F.col("x") * 0.02)


def test_linear_fit_recovers_coefficients(spark):
    m = M.fit_rating_model(_train(spark), ["x"])
    lr = m.stages[-1]
    assert abs(lr.intercept - 0.1) < 1e-9 and abs(lr.coefficients[0] - 0.02) < 1e-9


def test_model_save_load(spark):
    m = M.fit_rating_model(_train(spark), ["x"])
    path = tempfile.mkdtemp() + "/model"
    M.save_model(m, path, epoch=3, best_val_loss=0.5, spark=spark, checkpoints_table=path + "_ckpt")
    back = M.load_model(path)
    a = M.score(m, _train(spark)).select("pred").collect()
    b = M.score(back, _train(spark)).select("pred").collect()
    assert a == b
    assert spark.read.parquet(path + "_ckpt").collect()[0].epoch == 3


def test_score_batch_matches_expression(spark):
    df = _train(spark)
    s = M.score_batch(df, M.linear_predict_fn(0.2, [0.05]), ["x"]).collect()
    for r in s:
        assert r.pred == min(max(0.2 + 0.05 * r.x, 0.0), 1.0)


def test_dataset_pipeline(spark):
    g = spark.range(100).select(F.col("id").alias("game_id"), F.lit(1500).alias("white_elo"),
                                F.lit(1400).alias("black_elo"), F.lit("1-0").alias("result"),
                                F.array(F.lit("8/8/8/8/8/8/8/K6k w - - 0 1")).alias("fens"))
    sp = split.split_exact(g)
    d = M.dataset_pipeline(sp, epochs=(0, 1), max_len=4)
    assert d.count() == 200
    r = d.first()
    assert len(r.seq) == 4 and r.length == 1 and abs(r.elo - 0.35) < 1e-6


def test_game_features(spark):
    g = spark.createDataFrame([(1, ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
                                    "8/8/8/8/8/8/8/K6k w - - 0 1"])], "game_id long, fens array<string>")
    r = M.game_features(g).collect()[0]
    assert (r.n_positions, r.final_white, r.final_black, r.mean_pieces) == (2.0, 1.0, 1.0, 17.0)


def test_game_features_of_every_shape(spark):
    a, b = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w", "8/8/8/8/8/8/8/K6k b - - 0 1"
    rows = [(1, [a, b, a, None]), (2, []), (3, None), (4, [b]), (5, [None, a])]
    df = spark.createDataFrame(rows, "game_id long, fens array<string>").withColumn("final_white", F.lit("clash"))
    got = [(r.n_positions, r.final_white, r.final_black, r.mean_pieces) for r in M.game_features(df).collect()]
    assert got == [(4.0, 0.0, 0.0, 16.5), (0.0, None, None, 0.0), (0.0, None, None, 0.0), (1.0, 1.0, 1.0, 2.0), (2.0, 16.0, 16.0, 16.0)]
    assert M.game_features(df.limit(0)).collect() == []

import numpy as np

from fianchetto.operators import attention, metrics


def _scored(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, 1, n)
    p = np.clip(t + rng.normal(0, 0.1, n), 0, 1)
    return t, p, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, p))],
                                       "game_id long, target double, pred double")


def test_metrics_against_numpy(spark):
    t, p, df = _scored(spark)
    r = metrics.evaluate_predictions(df).collect()[0]
    assert abs(r.mse - np.mean((t - p) ** 2)) < 1e-12
    assert abs(r.mae - np.mean(np.abs(t - p))) < 1e-12
    r2 = 1 - np.sum((t - p) ** 2) / np.sum((t - t.mean()) ** 2)
    assert abs(r.r2 - r2) < 1e-9
    te = (t * 2000 + 800).astype(int)
    pe = (p * 2000 + 800).astype(int)
    assert abs(r.mae_elo - np.mean(np.abs(te - pe))) < 1e-9


def test_segments_half_open(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.2, 0.2), (3, 0.0, 0.1)], "game_id long, target double, pred double")
    seg = {r.label: r for r in metrics.segment_by_elo(df).collect()}
    assert set(seg) == {"Beginner", "Intermediate"}          # target 2800 falls in no band
    assert seg["Beginner"]["count"] == 1 and seg["Beginner"].mae == 200.0
    seg2 = {r.label: r for r in metrics.segment_by_elo(df, close_last=True).collect()}
    assert seg2["Master"]["count"] == 1


def test_histogram_against_numpy(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-300, 300, 1000)
    df = spark.createDataFrame([(int(x),) for x in v], "residual int")
    h = metrics.residual_histogram(df).orderBy("bin").collect()
    counts, edges = np.histogram(v, bins=50)
    assert [r["count"] for r in h] == counts.tolist()


def test_difficulty_segments(spark):
    seg = metrics.difficulty_segments(spark, 5).orderBy("segment").collect()
    assert [s.difficulty for s in seg] == ["Easy", "Normal", "Hard", "Impossible", "Level_5"]
    assert seg[4].color == "blue" and (seg[0].min_elo, seg[0].max_elo) == (800, 1200)


def test_top_positions(spark):
    df = spark.createDataFrame([(1, [0.1, 0.5, 0.2]), (2, [0.3, 0.5, 0.0])], "game_id long, weights array<float>")
    top = attention.top_positions(df, k=2).collect()
    assert [r.position for r in top] == [1, 0]

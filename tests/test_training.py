"""The training loop against plain Python, and sequence scoring against a loop over boards."""

import hashlib
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fianchetto.operators import attention, positions, split, training
from fianchetto.operators import model as M
from fianchetto.plans import catalog
from fianchetto.plans.bindings import FEN_POOL
from fianchetto.plans.catalog import SEQUENCE_TABLE
from tests.conftest import SMALL

N = 230


def _samples(spark):
    df = spark.range(N).select(F.col("id").alias("game_id"), ((F.col("id") * 13) % 29 / 29).alias("a"), ((F.col("id") * 7) % 11 / 11).alias("b"))
    df = df.withColumn("target", 0.2 + 0.5 * F.col("a") - 0.1 * F.col("b") + ((F.col("game_id") * 31) % 17 - 8) / 400)
    return split.split_exact(df, materialize=True)


def _plain(rows, epochs, rounds, lr, batch=32):
    """The same training over Python lists: (weights, history, batch log)."""
    train = [r for r in rows if r.split == "train"]
    val = [r for r in rows if r.split == "val"]
    w, hist, log = np.zeros(3), [], []
    for e in range(epochs):
        order = sorted(train, key=lambda r: (hashlib.md5(f"42:{e}:{r.game_id}".encode()).hexdigest(), r.game_id))
        batches = [order[i : i + batch] for i in range(0, len(order), batch)]
        seen = []
        for r in range(rounds):
            grad, n = np.zeros(3), 0
            for i, b in enumerate(batches):
                if i % rounds == r:
                    x = np.array([[1, s.a, s.b] for s in b])
                    err = x @ w - np.array([s.target for s in b])
                    seen.append((e, r, i, (err**2).mean(), np.abs(err).mean(), len(b)))
                    grad, n = grad + x.T @ err, n + len(b)
            w = w - lr * 2 * grad / n if n else w
        log += seen
        p = np.clip(np.array([[1, s.a, s.b] for s in val]) @ w, 0, 1)
        err = p - np.array([s.target for s in val])
        total = sum(s[5] for s in seen)
        hist.append((e, sum(s[3] * s[5] for s in seen) / total, sum(s[4] * s[5] for s in seen) / total, (err**2).mean(), np.abs(err).mean()))
    return w, hist, log


@pytest.mark.parametrize("rounds", [1, 4])
def test_training_equals_plain_python(spark, rounds):
    samples = _samples(spark)
    t = training.train_epochs(samples, ["a", "b"], tempfile.mkdtemp() + "/t", epochs=3, rounds=rounds, lr=0.4)
    w, hist, log = _plain(samples.collect(), 3, rounds, 0.4)
    assert np.allclose(t.weights, w, atol=1e-12)
    got = [tuple(r) for r in t.history().orderBy("epoch").select("epoch", "train_loss", "train_mae", "val_loss", "val_mae").collect()]
    assert np.allclose(got, hist, atol=1e-12)
    got = [tuple(r) for r in t.batch_log().orderBy("epoch", "round", "step").select("epoch", "round", "step", "loss", "mae", "n").collect()]
    assert np.allclose(got, sorted(log), atol=1e-12)
    epoch, best = t.best_weights()
    assert epoch == 2 and best == t.weights and training.load_weights(spark, t.path, 0)[0] == 0
    with pytest.raises(ValueError):
        training.load_weights(spark, t.path, 9)


def test_rate_falls_and_training_stops_without_improvement(spark):
    samples = _samples(spark).withColumn("target", F.lit(0.0))     # nothing to learn: the loss stays 0
    path = tempfile.mkdtemp() + "/t"
    t = training.train_epochs(samples, ["a"], path, epochs=9, lr=0.1, patience=4, lr_patience=1)
    h = t.history().orderBy("epoch").collect()
    assert t.stopped == 4 and len(h) == 5 and [r.improved for r in h] == [True] + [False] * 4
    assert [r.lr for r in h] == [0.1, 0.1, 0.1, 0.05, 0.05]
    # a shorter training in the same folder leaves nothing of the longer one
    t = training.train_epochs(samples, ["a"], path, epochs=1, lr=0.1)
    assert t.history().count() == 1 and t.stopped is None and t.best_weights() == (0, [0.0, 0.0])


def test_without_samples_and_with_nulls(spark):
    none = training.train_epochs(_samples(spark).where("split = 'val'"), ["a"], tempfile.mkdtemp() + "/t", epochs=1, rounds=2, lr=0.1)
    assert none.weights == [0.0, 0.0] and none.batch_log().count() == 0
    holes = _samples(spark).withColumn("a", F.when(F.col("game_id") % 3 > 0, F.col("a")))
    t = training.train_epochs(holes, ["a"], tempfile.mkdtemp() + "/t", epochs=1, lr=0.1)
    assert t.batch_log().agg(F.sum("n")).first()[0] == holes.where("a IS NOT NULL AND split = 'train'").count()


def _games(spark):
    rows = [(i, [FEN_POOL[(i * 3 + p) % 16] for p in range(i)], 1500, 1600, "1-0") for i in (0, 1, 3, 8, 12)]
    return spark.createDataFrame(rows, "game_id long, fens array<string>, white_elo int, black_elo int, result string")


def test_sequence_scores_equal_a_loop(spark):
    samples = positions.build_samples(_games(spark), max_len=9)
    got = M.score_sequences(samples, M.linear_sequence_model(SEQUENCE_TABLE), max_len=9, batch_size=2)
    for r in got.collect():
        scores = [sum(SEQUENCE_TABLE[i] for i in slot) for slot in r.seq[: r.length]]
        assert r.pred == min(max(0.5 + sum(scores) / max(r.length, 1), 0.0), 1.0)
        assert r.weights == [abs(s) for s in scores] + [0.0] * (9 - r.length)
    top = attention.top_positions(got, k=3).collect()
    assert len(top) == 3 and top[0].score >= top[2].score


def test_a_model_sees_dense_boards_and_lengths(spark):
    def make():
        def model(boards, lengths):
            assert boards.shape[2:] == (13, 8, 8) and boards.dtype == np.float32 and boards.shape[1] == max(1, lengths.max())
            assert set(np.unique(boards)) <= {0.0, 1.0}
            return boards.sum(axis=(1, 2, 3, 4))[:, None], boards.sum(axis=(2, 3, 4))     # [batch, 1] and beyond 1
        return model

    samples = positions.build_samples(_games(spark), max_len=20)
    got = {r.game_id: r for r in M.score_sequences(samples, make, max_len=20, batch_size=3, out="p", weights="w").collect()}
    assert got[0].p == 0.0 and got[8].p == 1.0 and got[0].w == [0.0] * 20
    assert got[12].w[:12] == [float(len(s)) for s in got[12].seq[:12]]


def test_games_are_scored_as_they_lie(spark):
    """No wide row is sorted or shuffled, no sequence is padded in the plan, and Arrow batches are bounded in bytes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = catalog._scored_sequences(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "array_repeat" not in plan and "SortMergeJoin [game_id" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20

"""Rules over training history: literal cases and, for the learning rate, a plain restatement."""

import random

import pytest

from fianchetto.operators import history


def _py_lr(vals, lr=1e-3, factor=0.5, patience=3, thr=1e-4, eps=1e-8):
    best, bad, out = float("inf"), 0, []
    for e, v in vals:
        used = lr
        if v < best * (1 - thr):
            best, bad = v, 0
        else:
            bad += 1
        if bad > patience:
            new = max(lr * factor, 0.0)
            if lr - new > eps:
                lr = new
            bad = 0
        out.append((e, used, lr))
    return out


def _hist(spark, seed=3, runs=20, epochs=25):
    rnd = random.Random(seed)
    rows = []
    for r in range(runs):
        v = 1.0
        for e in range(epochs):
            v = v * rnd.uniform(0.9, 1.08)
            rows.append((r, e, v, v, v, v))
    return rows, spark.createDataFrame(rows, "run long, epoch int, train_loss double, val_loss double, "
                                             "train_mae double, val_mae double")


NAN = float("nan")
# losses by epoch, patience, least improvement -> (stop epoch, best loss, epochs run)
STOPS = [
    ([0.5, 0.4, 0.45, 0.41, 0.42], 3, 0.0, (4, 0.4, 5)),
    ([0.5, 0.4, 0.45, 0.41, 0.39, 0.6], 3, 0.0, (None, 0.39, 6)),
    ([0.5, 0.45, 0.41, 0.30, 0.28, 0.26], 2, 0.1, (2, 0.5, 3)),
    ([0.5, 0.5, 0.5], 2, 0.0, (2, 0.5, 3)),
    ([0.5], 1, 0.0, (None, 0.5, 1)),
    ([NAN, 0.5, 0.6, 0.7], 3, 0.0, (3, NAN, 4)),
    ([0.5, NAN, NAN, 0.4, NAN], 3, 0.0, (None, 0.4, 5)),
    ([0.5, NAN, NAN, NAN, 0.1], 3, 0.0, (3, 0.5, 4)),
]


def _losses(spark, *runs):
    rows = [(r, e, v, v, v, v) for r, losses in enumerate(runs) for e, v in enumerate(losses)]
    return spark.createDataFrame(rows, "run long, epoch int, train_loss double, val_loss double, train_mae double, val_mae double")


@pytest.mark.parametrize(("losses", "patience", "delta", "want"), STOPS)
def test_early_stop(spark, losses, patience, delta, want):
    r = history.early_stop(_losses(spark, losses), patience, delta).collect()[0]
    assert repr((r.stop_epoch, r.best_loss, r.epochs_run)) == repr(want)


def test_nan_is_never_the_best(spark):
    df = _losses(spark, [NAN, 0.5, NAN, 0.6, 0.4], [NAN, NAN])
    assert [(r.epoch, r.improved) for r in history.running_best(df).where("run = 0").orderBy("epoch").collect()] == [
        (0, False), (1, True), (2, False), (3, False), (4, True)]
    best = {r.run: (r.best_epoch, r.best_loss, r.n_checkpoints) for r in history.best_epoch(df).collect()}
    assert best == {0: (4, 0.4, 2), 1: (None, None, 0)}


def test_lr_schedule_matches(spark):
    rows, df = _hist(spark, seed=5)
    got = {(r.run, r.epoch): (r.lr, r.next_lr) for r in history.lr_schedule(df).collect()}
    for run in range(20):
        vals = [(e, v) for (rr, e, v, *_rest) in rows if rr == run]
        for e, used, nxt in _py_lr(vals):
            assert got[(run, e)] == (used, nxt)


def test_best_and_final(spark):
    rows = [(1, 0, 3.0), (1, 1, 2.0), (1, 2, 2.0), (1, 3, 2.5)]
    df = spark.createDataFrame([(r, e, v, v, v, v) for r, e, v in rows],
                               "run long, epoch int, train_loss double, val_loss double, train_mae double, val_mae double")
    b = history.best_epoch(df).collect()[0]
    assert (b.best_epoch, b.best_loss, b.n_checkpoints) == (1, 2.0, 2)
    f = history.final_metrics(df).collect()[0]
    assert (f.last_epoch, f.val_loss) == (3, 2.5)


def test_final_metrics_elo(spark):
    df = spark.createDataFrame([(1, 0, 0.1, 0.2, 0.081552, 0.081105)],
                               "run long, epoch int, train_loss double, val_loss double, train_mae double, val_mae double")
    r = history.final_metrics(df, elo_scale=2000).collect()[0]
    assert abs(r.val_mae_elo - 162.21) < 1e-9 and abs(r.train_mae_elo - 163.104) < 1e-9

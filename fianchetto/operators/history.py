"""Training-history analytics (L7, W1-W6, M6) over many runs at once.

``history(run, epoch, train_loss, val_loss, train_mae, val_mae)`` has one row
per epoch.  Sequential rules (early stopping, the plateau learning-rate rule)
are folds over the epochs of one run: ``aggregate`` over the run's sorted
(epoch, loss) array.  That array is as long as the number of epochs of one run,
which training time bounds; runs are processed in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fianchetto.constants import (EARLY_STOP_MIN_DELTA, EARLY_STOP_PATIENCE, LR_EPS, LR_FACTOR,
                                  LR_PATIENCE, LR_THRESHOLD)


def history(train: DataFrame, val: DataFrame, keys=("run", "epoch")) -> DataFrame:
    """Join per-epoch train metrics (train_loss, train_mae) and validation metrics
    (val_loss, val_mae) on (run, epoch)."""
    return train.join(val, list(keys), "inner")


def running_best(hist: DataFrame, loss: str = "val_loss", run: str = "run",
                 epoch: str = "epoch") -> DataFrame:
    """Best loss before each epoch and whether this epoch improves on it (the
    checkpoint rule ``loss < best``, best starting at +inf; a NaN loss never
    improves and is never the best)."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.min(_number(loss)).over(w)
    below = _number(loss) < F.coalesce(prev, F.lit(float("inf")))
    return (hist.withColumn("best_before", prev)
            .withColumn("improved", F.coalesce(below, F.lit(False))))


def _number(loss: str):
    """The loss, NULL where it is NaN (Spark orders NaN above every number)."""
    return F.when(~F.isnan(F.col(loss).cast("double")), F.col(loss))


def best_epoch(hist: DataFrame, loss: str = "val_loss", run: str = "run",
               epoch: str = "epoch") -> DataFrame:
    """Per run: the earliest epoch with the minimum loss, that loss, and the
    number of checkpoints the strict-improvement rule saves.  NaN losses do not
    count; a run that has no other has no best epoch."""
    rb = running_best(hist, loss, run, epoch)
    return rb.groupBy(run).agg(
        F.min_by(F.col(epoch), F.when(_number(loss).isNotNull(), F.struct(F.col(loss), F.col(epoch)))).alias("best_epoch"),
        F.min(_number(loss)).alias("best_loss"),
        F.sum(F.col("improved").cast("int")).cast("int").alias("n_checkpoints"))


def _sorted_losses(hist, run, epoch, loss):
    return hist.groupBy(run).agg(
        F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"),
                                             F.col(loss).cast("double").alias("v")))).alias("_h"))


def early_stop(hist: DataFrame, patience: int = EARLY_STOP_PATIENCE,
               min_delta: float = EARLY_STOP_MIN_DELTA, loss: str = "val_loss",
               run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Per run: ``stop_epoch`` (NULL if never triggered), the best loss at the
    end of the fold, and the epoch count that was actually run.

    Rule: the first value sets best; a value ``< best - min_delta`` becomes the
    new best and resets the counter; otherwise the counter grows and training
    stops once it reaches ``patience``.  Comparisons with NaN are false, so a NaN
    loss counts as no improvement, and after a NaN first loss nothing improves.
    """
    init = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("cnt"),
                    F.lit(None).cast("int").alias("stop"))

    def step(s, x):
        first = s["best"].isNull()
        improved = ~F.isnan(s["best"]) & (x["v"] < s["best"] - F.lit(float(min_delta)))
        reset = first | improved
        cnt = F.when(reset, F.lit(0)).otherwise(s["cnt"] + 1)
        nxt = F.struct(F.when(reset, x["v"]).otherwise(s["best"]).alias("best"),
                       cnt.alias("cnt"),
                       F.when(~reset & (cnt >= patience), x["e"].cast("int")).alias("stop"))
        return F.when(s["stop"].isNotNull(), s).otherwise(nxt)

    folded = _sorted_losses(hist, run, epoch, loss).select(run, F.aggregate("_h", init, step).alias("s"),
                                                           F.col("_h"))
    return folded.select(
        run, F.col("s.stop").alias("stop_epoch"), F.col("s.best").alias("best_loss"),
        F.size(F.filter("_h", lambda x: F.col("s.stop").isNull() | (x["e"] <= F.col("s.stop"))))
        .alias("epochs_run"))


def truncate_history(hist: DataFrame, stops: DataFrame, run: str = "run",
                     epoch: str = "epoch") -> DataFrame:
    """Drop the epochs after each run's early stop."""
    j = hist.join(stops.select(run, "stop_epoch"), run, "left")
    return j.where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch"))) \
        .drop("stop_epoch")


def lr_schedule(hist: DataFrame, lr0: float = 1e-3, factor: float = LR_FACTOR,
                patience: int = LR_PATIENCE, threshold: float = LR_THRESHOLD,
                min_lr: float = 0.0, eps: float = LR_EPS, loss: str = "val_loss",
                run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Reduce-on-plateau learning rate per (run, epoch): ``lr`` in effect during
    the epoch and ``next_lr`` after the step on that epoch's loss.

    Relative threshold, mode 'min', no cooldown: a loss is better when
    ``loss < best * (1 - threshold)``; after more than ``patience`` bad epochs
    the rate is multiplied by ``factor`` (if the change exceeds ``eps``)."""
    rel = 1.0 - threshold
    init = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"),
                    F.lit(float(lr0)).alias("lr"),
                    F.array().cast("array<struct<e:int,lr:double,next_lr:double>>").alias("out"))

    def step(s, x):
        better = ~F.isnan(s["best"]) & (x["v"] < s["best"] * F.lit(rel))
        bad = F.when(better, F.lit(0)).otherwise(s["bad"] + 1)
        reduce = bad > patience
        cand = F.greatest(s["lr"] * F.lit(float(factor)), F.lit(float(min_lr)))
        new_lr = F.when(reduce & ((s["lr"] - cand) > F.lit(float(eps))), cand).otherwise(s["lr"])
        rec = F.struct(x["e"].cast("int").alias("e"), s["lr"].alias("lr"), new_lr.alias("next_lr"))
        return F.struct(F.when(better, x["v"]).otherwise(s["best"]).alias("best"),
                        F.when(reduce, F.lit(0)).otherwise(bad).alias("bad"),
                        new_lr.alias("lr"), F.array_append(s["out"], rec).alias("out"))

    folded = _sorted_losses(hist, run, epoch, loss).select(run, F.aggregate("_h", init, step)["out"].alias("o"))
    return folded.select(run, F.inline("o")).withColumnRenamed("e", epoch)


def final_metrics(hist: DataFrame, run: str = "run", epoch: str = "epoch",
                  cols=("train_loss", "val_loss", "train_mae", "val_mae"),
                  elo_scale: float | None = None) -> DataFrame:
    """The last epoch of each run and its metrics.  ``elo_scale`` (e.g. 2000,
    the rating span) adds ``*_mae_elo`` columns: normalised MAE in points."""
    last = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(epoch))
    out = hist.groupBy(run).agg(F.max(epoch).alias("last_epoch"), last.alias("_l")) \
        .select(run, "last_epoch", *[F.col(f"_l.{c}").alias(c) for c in cols])
    if elo_scale:
        for c in cols:
            if c.endswith("_mae"):
                out = out.withColumn(f"{c}_elo", F.col(c) * F.lit(float(elo_scale)))
    return out


def compare_runs(hist: DataFrame, configs: DataFrame | None = None, run: str = "run",
                 patience: int = EARLY_STOP_PATIENCE, min_delta: float = EARLY_STOP_MIN_DELTA) -> DataFrame:
    """Side-by-side run summary: final metrics of the (early-stopped) history,
    best epoch and stop epoch, optionally with each run's config; ranked by
    final validation MAE."""
    stops = early_stop(hist, patience, min_delta, run=run)
    kept = truncate_history(hist, stops, run=run)
    out = (final_metrics(kept, run=run).join(best_epoch(kept, run=run), run)
           .join(stops.select(run, "stop_epoch"), run))
    if configs is not None:
        out = out.join(configs, run, "left")
    # a distributed range-partitioned sort, not a single-partition rank window
    return out.orderBy(F.col("val_mae"), F.col(run))

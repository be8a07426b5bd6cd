"""Mini-batch training over Spark (M1): epochs of batches, a real batch log, history, checkpoints.

The model is linear in the features.  An epoch's shuffled batches (L5) are dealt into ``rounds``; a round is one aggregate
that gives, batch by batch, the losses before the update and the sums of the gradient, and one step of the weights from the
round's total.  With as many rounds as batches this is the plain sequential rule, with one it is a full step an epoch; in
between, a round's batches are computed side by side.  What the driver holds are the weights and the gradient's total.

The rules around it are the library's own: the epoch's metrics are A12 over the batch log, validation is A11, the rate
follows W3, checkpoints are the improvements of W4/L7, and W2 stops.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fianchetto.constants import BATCH_SIZE, EARLY_STOP_MIN_DELTA, EARLY_STOP_PATIENCE, LR_PATIENCE, SPLIT_SEED
from fianchetto.functions.elo import clip_prediction
from fianchetto.operators import history as H
from fianchetto.operators import metrics
from fianchetto.operators.split import assign_batches

HISTORY = "run string, epoch int, train_loss double, train_mae double, val_loss double, val_mae double, lr double, improved boolean"


LOG = "run string, step long, loss double, mae double, n long, gradient array<double>"


def _batch_log(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.schema(LOG + ", epoch int, round int").parquet(f"{path}/batch_log")
    return log.select("run", "epoch", "round", "step", "loss", "mae", "n", "gradient")


@dataclass
class Training:
    """A finished training: its tables' folder, the last weights (bias first) and the epoch after which it stopped."""

    spark: SparkSession
    path: str
    features: list[str]
    weights: list[float]
    stopped: int | None

    def history(self) -> DataFrame:
        """run, epoch, train_loss, train_mae, val_loss, val_mae, lr, improved."""
        return self.spark.read.schema(HISTORY).parquet(f"{self.path}/history").drop("e")

    def batch_log(self) -> DataFrame:
        """run, epoch, round, step (the batch), loss, mae, n: before the update, as training saw them."""
        return _batch_log(self.spark, self.path).drop("gradient")

    def best_weights(self) -> tuple[int, list[float]]:
        return load_weights(self.spark, self.path)

    def predict(self, df: DataFrame, weights: Sequence[float] | None = None, out: str = "pred") -> DataFrame:
        return df.withColumn(out, clip_prediction(linear(self.features, weights or self.weights)))


def linear(features: Sequence[str], weights: Sequence[float]) -> Column:
    """bias + the weighted sum of the features, in the order given."""
    total = F.lit(float(weights[0]))
    for name, w in zip(features, weights[1:], strict=True):
        total = total + F.lit(float(w)) * F.col(name)
    return total


def load_weights(spark: SparkSession, path: str, epoch: int | None = None) -> tuple[int, list[float]]:
    """(epoch, weights) of a checkpoint; the best one, that is the latest improvement, unless an epoch is named (M4)."""
    table = spark.read.parquet(f"{path}/checkpoints")
    if epoch is not None:
        table = table.where(F.col("epoch") == epoch)
    best = table.agg(F.max(F.struct("epoch", "weights")).alias("b")).first().b
    if best is None:
        raise ValueError(f"no checkpoint of epoch {epoch} under {path}")
    return best.epoch, list(best.weights)


def train_epochs(samples: DataFrame, features: Sequence[str], path: str, label: str = "target", epochs: int = 10,
                 batch_size: int = BATCH_SIZE, rounds: int = 1, lr: float = 1e-3, patience: int = EARLY_STOP_PATIENCE,
                 min_delta: float = EARLY_STOP_MIN_DELTA, lr_patience: int = LR_PATIENCE, seed: int = SPLIT_SEED,
                 run: str = "run") -> Training:
    """Train on the ``train`` split of samples (game_id, split, split_rk, features, label), judged on ``val``.

    Squared loss, plain gradient steps.  Writes under ``path``: ``samples`` (once, narrow), and per epoch ``batch_log``,
    ``history`` and, where the validation loss improves, ``checkpoints``; what these folders held is replaced.  Rows with a
    NULL feature or label take no part; without training rows the weights stay 0.
    """
    spark = samples.sparkSession
    for old in ("epochs", "batch_log", "history", "checkpoints"):
        _clear(spark, f"{path}/{old}")
    features = list(features)
    kept = samples.select("game_id", "split", "split_rk", *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("y"))
    kept.dropna(subset=[*features, "y"]).write.mode("overwrite").partitionBy("split").parquet(f"{path}/samples")
    table = spark.read.schema(kept.schema).parquet(f"{path}/samples")
    train, val = table.where("split = 'train'"), table.where("split = 'val'").select(*features, "y")
    weights, rate, rows, stopped = [0.0] * (len(features) + 1), float(lr), [], None
    for epoch in range(epochs):
        dealt = _deal(train, features, epoch, batch_size, rounds, seed, f"{path}/epochs/epoch={epoch}")
        for r in range(rounds):
            gradient = _round(spark, dealt, features, weights, run, epoch, r, f"{path}/batch_log/epoch={epoch}/round={r}")
            weights = [w - rate * g for w, g in zip(weights, gradient, strict=True)]
        seen = metrics.train_epoch_metrics(_batch_log(spark, path).where(F.col("epoch") == epoch)).first()
        judged = metrics.evaluate_predictions(val.select(F.col("y").alias("target"), clip_prediction(linear(features, weights)).alias("pred")), elo=False).first()
        rows.append((run, epoch, seen and seen.loss, seen and seen.mae, judged.mse, judged.mae, rate))
        hist = spark.createDataFrame(rows, HISTORY.rsplit(",", 1)[0])
        now = H.running_best(hist).where(F.col("epoch") == epoch).drop("best_before")
        now.select(*[c.split()[0] for c in HISTORY.split(", ")]).coalesce(1).write.mode("overwrite").parquet(f"{path}/history/e={epoch}")
        if now.first().improved:
            (spark.createDataFrame([(run, epoch, float(judged.mse), weights)], "run string, epoch int, val_loss double, weights array<double>")
             .coalesce(1).write.mode("overwrite").parquet(f"{path}/checkpoints/e={epoch}"))
        rate = H.lr_schedule(hist, lr0=lr, patience=lr_patience).where(F.col("epoch") == epoch).first().next_lr
        stopped = H.early_stop(hist, patience, min_delta).first().stop_epoch
        if stopped is not None:
            break
    return Training(spark, path, features, weights, stopped)


def _clear(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that holds it, wherever that is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _deal(train: DataFrame, features, epoch: int, batch_size: int, rounds: int, seed: int, path: str) -> DataFrame:
    """The epoch's samples with their batch, written once and parted by round: each round reads its own batches only."""
    batches = assign_batches(train.select("game_id", "split", "split_rk"), (epoch,), batch_size, seed=seed).select("game_id", "batch_id")
    (train.select("game_id", *features, "y").join(batches, "game_id").drop("game_id")
     .withColumn("round", (F.col("batch_id") % rounds).cast("int")).write.mode("overwrite").partitionBy("round").parquet(path))
    kinds = ", ".join(f"{c} double" for c in [*features, "y"])
    return train.sparkSession.read.schema(f"{kinds}, batch_id long, round int").parquet(path)


def _round(spark, dealt: DataFrame, features, weights, run: str, epoch: int, r: int, path: str) -> list[float]:
    """Write the round's batch log with each batch's gradient sums; return the mean gradient (zeros without samples)."""
    err = F.col("_err")
    rows = dealt.where(F.col("round") == r).withColumn("_err", linear(features, weights) - F.col("y"))
    batch = rows.groupBy("batch_id").agg(
        F.avg(err * err).alias("loss"), F.avg(F.abs(err)).alias("mae"), F.count(F.lit(1)).alias("n"),
        F.array(F.sum(err), *[F.sum(err * F.col(c)) for c in features]).alias("gradient"))
    batch.select(F.lit(run).alias("run"), F.col("batch_id").alias("step"), "loss", "mae", "n", "gradient").write.mode("overwrite").parquet(path)
    log = spark.read.schema(LOG).parquet(path)
    total = log.agg(F.sum("n").alias("n"), *[F.sum(F.col("gradient")[i]).alias(f"g{i}") for i in range(len(weights))]).first()
    return [2.0 * total[f"g{i}"] / total.n if total.n else 0.0 for i in range(len(weights))]

"""Rating models (M1-M5), re-aimed at Spark ML.

The original trains a neural sequence model in one process.  Here a regressor
is fitted with ``pyspark.ml`` on per-game features computed from the game rows
themselves (array functions, no shuffle); batch scoring of an external model
uses ``predict_batch_udf`` (Arrow batches, one model per Python worker).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fianchetto.constants import BATCH_SIZE, BOARD_CHANNELS, MAX_SEQUENCE_LENGTH
from fianchetto.operators.positions import build_samples, list_sizes
from fianchetto.operators.split import assign_batches
from fianchetto.session import small_batches


GAME_FEATURES = ("n_positions", "final_white", "final_black", "mean_pieces")


def game_features(games: DataFrame, fens_col: str = "fens") -> DataFrame:
    """Per-game numeric features from the game's own FEN array: number of positions,
    final material (white, black; NULL without positions), mean piece count.  Pieces are counted
    once for each distinct FEN of an Arrow batch; a NULL FEN has none.  No shuffle."""
    small_batches(games.sparkSession)
    kept = games.drop(*GAME_FEATURES)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(c, T.DoubleType()) for c in GAME_FEATURES]])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fens = batch.column(batch.schema.get_field_index(fens_col))
            size = list_sizes(fens)
            coded = fens.flatten().dictionary_encode()
            boards = [f.split(" ", 1)[0] for f in coded.dictionary.to_pylist()]
            entry = coded.indices.fill_null(len(boards)).to_numpy(zero_copy_only=False)
            white, black = (np.array([*(sum(map(b.count, p)) for b in boards), 0], np.float64)[entry] for p in ("PNBRQK", "pnbrqk"))
            total = np.bincount(np.repeat(np.arange(len(size)), size), white + black, len(size))
            last, some = np.cumsum(size) - 1, size > 0
            ends = [pa.array(np.where(some, x[np.where(some, last, 0)], 0) if len(x) else np.zeros(len(size)), mask=~some) for x in (white, black)]
            made = [pa.array(size.astype(np.float64)), *ends, pa.array(total / np.maximum(size, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *GAME_FEATURES])

    return kept.mapInArrow(run, schema)


TOKEN_FEATURES = ("n_moves", "captures", "checks", "castles", "promotions")


def token_features(games: DataFrame, moves: str = "moves") -> DataFrame:
    """Per-game numbers straight from the SAN tokens (no replay, no shuffle)."""
    def holding(sign):
        return F.size(F.filter(moves, lambda t: F.contains(t, F.lit(sign)))).cast("double")

    return games.withColumns({
        "n_moves": F.size(moves).cast("double"), "captures": holding("x"),
        "checks": holding("+") + holding("#"), "castles": holding("O-O"), "promotions": holding("=")})


def fit_rating_model(train: DataFrame, features: Sequence[str], label: str = "target",
                     kind: str = "linear", **params) -> PipelineModel:
    """Fit ``VectorAssembler -> regressor`` with squared loss on ``label``."""
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    if kind == "linear":
        reg = LinearRegression(featuresCol="features", labelCol=label, predictionCol="pred",
                               solver=params.pop("solver", "normal"), **params)
    elif kind == "gbt":
        reg = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="pred", **params)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return Pipeline(stages=[asm, reg]).fit(train)


def score(model: PipelineModel, df: DataFrame, clip: bool = True) -> DataFrame:
    """Apply a fitted pipeline (JVM-side); predictions clipped to [0, 1]."""
    out = model.transform(df).drop("features")
    return out.withColumn("pred", F.least(F.greatest(F.col("pred"), F.lit(0.0)), F.lit(1.0))) if clip else out


def score_batch(df: DataFrame, make_predict_fn: Callable, input_cols: Sequence[str],
                batch_size: int = BATCH_SIZE * 32, out: str = "pred",
                input_tensor_shapes=None) -> DataFrame:
    """Batch inference with an external model: ``make_predict_fn()`` is called
    once per Python worker and returns ``predict(*arrays) -> array``."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=input_tensor_shapes)
    return df.withColumn(out, udf(*[F.col(c) for c in input_cols]))


SQUARES = 64


def score_sequences(samples: DataFrame, make_model: Callable, max_len: int = MAX_SEQUENCE_LENGTH,
                    batch_size: int = BATCH_SIZE, out: str = "pred", weights: str = "weights") -> DataFrame:
    """Batch inference of a sequence model: adds ``out`` DOUBLE and ``weights`` ARRAY<FLOAT> (one per slot, the input of
    ``top_positions``) to samples with ``seq`` (``max_len`` slots of one-hot indices) and ``length``.

    ``make_model()`` is called once per task and returns ``model(boards, lengths) -> (pred, weights)``, where
    ``boards`` is float32 [batch, slots, 13, 8, 8], ``lengths`` is [batch], ``pred`` is [batch] or [batch, 1] and ``weights``
    [batch, slots].  Sequences travel as they are, sparse, in Arrow batches of bounded size; only a batch at a time is made
    dense, as many slots of it as its longest sequence has.  Predictions are clipped to [0, 1]; slots that a model was not
    shown weigh 0."""
    small_batches(samples.sparkSession)
    kept = samples.drop(out, weights)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(weights, T.ArrayType(T.FloatType()))])
    return kept.mapInArrow(_sequence_scorer(make_model, max_len, batch_size, out, weights), schema)


def _sequence_scorer(make_model: Callable, max_len: int, batch_size: int, out: str, weights: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = make_model()
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_size):
                games = batch.slice(lo, batch_size)
                n = games.num_rows
                length = games.column(games.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
                slots = max(1, int(length.max(initial=0)))
                boards = np.zeros((n, slots, BOARD_CHANNELS * SQUARES), np.float32)
                seq = games.column(games.schema.get_field_index("seq"))
                per_game, lists = list_sizes(seq), seq.flatten()
                per_slot, index = list_sizes(lists), lists.flatten().to_numpy(zero_copy_only=False)
                game = np.repeat(np.repeat(np.arange(n), per_game), per_slot)
                slot = np.repeat(np.arange(len(lists)) - np.repeat(np.cumsum(per_game) - per_game, per_game), per_slot)
                shown = slot < slots
                boards[game[shown], slot[shown], index[shown]] = 1
                pred, seen = model(boards.reshape(n, slots, BOARD_CHANNELS, 8, 8), length)
                weight = np.zeros((n, max_len), np.float32)
                weight[:, :slots] = seen
                made = [pa.array(np.clip(np.asarray(pred, np.float64).reshape(-1), 0.0, 1.0)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * max_len), pa.array(weight.ravel()))]
                yield pa.RecordBatch.from_arrays([*games.columns, *made], [*games.schema.names, out, weights])

    return run


def linear_sequence_model(table: Sequence[float], bias: float = 0.5):
    """A model for ``score_sequences``: a position scores the sum of ``table`` (one number per channel and square) over its
    set squares; the prediction is ``bias`` plus the mean score, a position's weight its score without sign."""
    def make():
        import numpy as np

        values = np.asarray(table, np.float32)

        def model(boards, lengths):
            scores = boards.reshape(*boards.shape[:2], -1) @ values
            total = scores.sum(axis=1, dtype=np.float64)
            return bias + total / np.maximum(lengths, 1), np.abs(scores)
        return model
    return make


def linear_predict_fn(intercept: float, coefs: Sequence[float]):
    """A numpy scorer ``clip(intercept + sum(c_i * x_i), 0, 1)`` for ``score_batch``."""
    def make():
        import numpy as np

        w = [float(c) for c in coefs]

        def predict(*xs):
            acc = np.full(len(xs[0]), float(intercept))
            for c, x in zip(w, xs):
                acc = acc + c * np.asarray(x, dtype=np.float64)
            return np.clip(acc, 0.0, 1.0)
        return predict
    return make


def save_model(model: PipelineModel, path: str, epoch: int | None = None,
               best_val_loss: float | None = None, spark: SparkSession | None = None,
               checkpoints_table: str | None = None) -> str:
    """Persist a model; optionally append ``(path, epoch, best_val_loss)`` to a
    Parquet table of checkpoints."""
    model.write().overwrite().save(path)
    if checkpoints_table and spark is not None:
        spark.createDataFrame([(path, epoch, best_val_loss)],
                              "path string, epoch int, best_val_loss double") \
            .write.mode("append").parquet(checkpoints_table)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_checkpoint(spark: SparkSession, path: str, checkpoints_table: str) -> tuple[PipelineModel, int | None, float | None]:
    """The model saved at ``path`` with the epoch and best validation loss that
    ``save_model`` noted for it (the latest epoch, if noted more than once)."""
    info = (spark.read.parquet(checkpoints_table).where(F.col("path") == path)
            .agg(F.max(F.struct("epoch", "best_val_loss")).alias("i")).first().i)
    return load_model(path), info and info.epoch, info and info.best_val_loss


def dataset_pipeline(split_df: DataFrame, epochs=(0,), batch_size: int = BATCH_SIZE,
                     use_white_elo: bool = True, max_len: int = 200, derived: dict[str, Column] | None = None) -> DataFrame:
    """Samples for every split with their batch assignment per epoch (train
    reshuffled per epoch, val/test in order).  ``derived`` columns are computed from a sample, once for all its epochs."""
    batches = assign_batches(split_df.select("game_id", "split", "split_rk"), epochs, batch_size)
    # a game's epochs as one short list: its sample is encoded once, and the wide
    # sequence never goes through a shuffle. The narrow side is hashed, so the games with their FENs are not sorted
    slots = batches.groupBy("game_id").agg(F.collect_list(F.struct("split", "split_rk", "epoch", "batch_id", "batch_pos")).alias("_slots"))
    games = split_df.drop("split", "split_rk").join(slots.hint("shuffle_hash"), "game_id")
    samples = build_samples(games, use_white_elo=use_white_elo, max_len=max_len, keep=("_slots",)).withColumns(derived or {})
    return samples.select(*[c for c in samples.columns if c != "_slots"], F.inline("_slots"))

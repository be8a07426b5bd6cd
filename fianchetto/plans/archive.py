"""End-to-end jobs equivalent to the original command-line scripts.

``preprocess_archive``: PGN dump(s) -> games and positions tables + split table
(scan, framing, parsing, filters, replay, exact split, writes).
``train_and_evaluate``: split table -> fitted model, test metrics, per-band
report, training log and run config.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fianchetto.constants import SPLIT_SEED, SPLIT_TRAIN, SPLIT_VAL
from fianchetto.functions.elo import normalize_elo
from fianchetto.operators import framing, games, metrics, model, replay, split
from fianchetto.sinks import writers
from fianchetto.sources import pgn, runs


def preprocess_archive(spark: SparkSession, input_path: str, output_dir: str,
                       mode: str = "clean", max_games: int | None = None,
                       train_ratio: float = SPLIT_TRAIN, val_ratio: float = SPLIT_VAL,
                       seed: int = SPLIT_SEED, materialize: bool = True,
                       replay_moves: bool = False) -> dict:
    """Write ``games`` (parsed, valid) and ``splits`` (partitioned by split) under
    ``output_dir``; return split counts, rejects and the rate of games written.
    ``replay_moves`` also replays them and writes ``positions``.

    ``clean`` framing of plain text frames inside the reader (one pass, no
    shuffle); ``reference`` applies the original blank-line rule on lines."""
    began = time.time()
    if mode == "clean":
        recs = pgn.scan_pgn_games(spark, input_path)
    else:
        recs = framing.frame_games(pgn.scan_pgn_lines(spark, input_path), mode=mode,
                                   materialize=materialize)
    parsed = games.parse_games(recs)
    if materialize:
        from fianchetto.operators.ordered import materialize_df
        parsed = materialize_df(parsed.drop("game_text"))
    rejects = {r.parse_status: r.n_games for r in games.reject_counts(parsed).collect()}
    ok = games.valid_games(parsed).select("game_id", "file", "first_ln", "white_elo", "black_elo",
                                          "result", "moves")
    ok = games.max_games(ok, max_games)
    if replay_moves:
        ok = replay.finalize_games(replay.replay_games(ok))
    games_path = os.path.join(output_dir, "games")
    writers.write_games(ok, games_path)
    g = spark.read.parquet(games_path)
    if replay_moves:
        writers.write_games(replay.positions_table(g), os.path.join(output_dir, "positions"))
    sp = split.split_exact(g, train_ratio=train_ratio, val_ratio=val_ratio, seed=seed)
    writers.write_splits(sp, os.path.join(output_dir, "splits"))
    counts = {r.split: r.n_games for r in split.split_counts(
        spark.read.parquet(os.path.join(output_dir, "splits"))).collect()}
    return {"splits": counts, "rejects": rejects, "games_per_sec": sum(counts.values()) / (time.time() - began)}


def train_and_evaluate(spark: SparkSession, data_dir: str, out_dir: str,
                       use_white_elo: bool = True, kind: str = "linear", run_id: str = "run",
                       **params) -> dict:
    """Fit a rating model on the train split, score val and test, and write
    the evaluation report, the training log line and the run configuration."""
    splits = os.path.join(data_dir, "splits")

    def prepared(name: str) -> DataFrame:
        df = model.token_features(runs.read_splits(spark, splits, name))
        side = "white_elo" if use_white_elo else "black_elo"
        return df.withColumn("target", normalize_elo(side))

    feats = list(model.TOKEN_FEATURES)
    m = model.fit_rating_model(prepared("train"), feats, label="target", kind=kind, **params)
    model.save_model(m, os.path.join(out_dir, "model"))
    scored = {s: model.score(m, prepared(s)).withColumn("batch_id", (F.col("split_rk") / 32).cast("long"))
              for s in ("train", "val", "test")}
    test_metrics = metrics.evaluate_predictions(scored["test"]).drop("n")
    writers.write_report(test_metrics, metrics.segment_by_elo(scored["test"]), os.path.join(out_dir, "report"))
    tr = metrics.regression_metrics(scored["train"]).select(F.col("mae").alias("train_mae"))
    va = metrics.validate(scored["val"]).select(F.col("mae").alias("val_mae"), F.col("loss").alias("val_loss"))
    # one-row frames combined through scalar subqueries (no join needed)
    hist = tr.withColumn("val_mae", va.select("val_mae").scalar()) \
        .withColumn("val_loss", va.select("val_loss").scalar())
    hist = hist.withColumn("epoch", F.lit(0)).withColumn("run", F.lit(run_id))
    writers.write_log(hist, os.path.join(out_dir, "log"), partition_by="run")
    cfg = spark.createDataFrame([(run_id, kind, str(params))], "run string, model string, params string")
    writers.write_run_config(cfg, os.path.join(out_dir, "configs"))
    return {"test": test_metrics.collect()[0].asDict(), "history": hist.collect()[0].asDict()}

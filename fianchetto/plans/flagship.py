"""The flagship plan: archive lines to a per-band evaluation of the test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fianchetto.functions.elo import clip_prediction, normalize_elo
from fianchetto.operators import framing, games, metrics, split
from fianchetto.plans import bindings as B


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.pgn_lines_b4(spark, sf_dir)
    recs = framing.frame_games(lines, mode="clean").withColumn(
        "game_id", F.floor(F.col("first_ln") / B.LINES_PER_GAME).cast("long"))
    valid = games.valid_games(games.parse_games(recs, id_col="game_id"))
    # the split ranks its input in two passes; checkpoint the parsed games so the
    # archive is framed and parsed once
    sp = split.split_exact(valid.select("game_id", "white_elo", "black_elo"), materialize=True)
    test = sp.where(F.col("split") == "test")
    # a transparent baseline scorer: the opponent's rating as the prediction
    scored = test.select("game_id", normalize_elo("white_elo").alias("target"),
                         clip_prediction(normalize_elo("black_elo")).alias("pred"))
    return metrics.segment_by_elo(scored).select("label", "range", "count", "mae", "rmse")

"""Sources and sinks: compressed scan, fast-path framing, run configs, logs, report."""

import json
import os
import tempfile

import zstandard
from pyspark.sql import functions as F

from fianchetto.operators import framing, games, metrics
from fianchetto.sinks import writers
from fianchetto.sources import pgn, runs

PGN = ('% a preamble line\n\n'
       '[Event "a"]\n[WhiteElo "1500"]\n[BlackElo "1400"]\n[Result "1-0"]\n\n1. e4 e5 2. Nf3 1-0\n\n'
       '[Event "b"]\n[WhiteElo "1500"]\n[BlackElo "1400"]\n[Result "0-1"]\n\n1. d4 d5 0-1\n\n')


def _write(tmp, name, text, zst=False):
    p = os.path.join(tmp, name)
    data = text.encode()
    if zst:
        data = zstandard.ZstdCompressor().compress(data)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_zst_line_scan_and_framing(spark):
    tmp = tempfile.mkdtemp()
    _write(tmp, "a.pgn.zst", PGN, zst=True)
    lines = pgn.scan_pgn_lines(spark, tmp)
    assert lines.count() == len(PGN.split("\n")) - 1
    recs = framing.frame_games(lines, mode="clean").orderBy("first_ln").collect()
    assert [r.game_text.split("\n")[0] for r in recs] == ['[Event "a"]', '[Event "b"]']


def test_fast_path_framing_matches_line_framing(spark):
    tmp = tempfile.mkdtemp()
    _write(tmp, "a.pgn", PGN * 3)
    fast = pgn.scan_pgn_games(spark, tmp)
    p = games.parse_games(fast.withColumn("game_id", F.col("first_ln")), id_col="game_id")
    st = sorted((r.white_elo, r.result, r.parse_status, tuple(r.moves)) for r in p.collect())
    slow = framing.frame_games(pgn.scan_pgn_lines(spark, tmp), mode="clean")
    q = games.parse_games(slow.withColumn("game_id", F.col("first_ln")), id_col="game_id")
    st2 = sorted((r.white_elo, r.result, r.parse_status, tuple(r.moves)) for r in q.collect())
    assert st == st2 and len(st) == 6


def test_pretty_json_configs(spark):
    tmp = tempfile.mkdtemp()
    cfg = {"model": "lstm", "batch_size": 32, "epochs": 2, "lr": 0.001, "dropout": 0.1,
           "embedding_dim": 128, "seed": 42, "device": "cpu"}
    for stamp in ("20251208_223851", "20251208_224153"):
        _write(tmp, f"config_{stamp}.json", json.dumps(cfg, indent=2))
    df = runs.read_run_configs(spark, tmp).orderBy("run_id").collect()
    assert [r.run_id for r in df] == ["20251208_223851", "20251208_224153"]
    assert df[0].model == "lstm" and df[0].run_time is not None


def test_log_line_format_and_parse(spark):
    h = spark.createDataFrame([(0, 0.081552, 0.081105), (1, 0.081064, 0.080164)],
                              "epoch int, train_mae double, val_mae double")
    lines = [r.value for r in writers.format_log(h).orderBy("epoch").collect()]
    assert lines == ["Epoch   0 | Train MAE: 0.081552 | Val MAE: 0.081105",
                     "Epoch   1 | Train MAE: 0.081064 | Val MAE: 0.080164"]
    back = runs.parse_log_lines(spark.createDataFrame([(l,) for l in lines] + [("noise",)], "value string"))
    assert [(r.epoch, r.val_mae, r.val_mae_elo) for r in back.orderBy("epoch").collect()] == \
        [(0, 0.081105, None), (1, 0.080164, None)]


def test_report_shape(spark):
    s = spark.createDataFrame([(1, 0.5, 0.45), (2, 0.1, 0.2)], "game_id long, target double, pred double")
    rep = writers.report_json(metrics.evaluate_predictions(s).drop("n"), metrics.segment_by_elo(s)).collect()[0]
    d = json.loads(rep.report)
    assert set(d) == {"overall_metrics", "segmentation"}
    assert set(d["segmentation"]) == {"Beginner", "Advanced"}
    assert set(d["segmentation"]["Advanced"]) == {"range", "count", "mae", "rmse"}


def test_missing_splits_message(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        runs.read_splits(spark, "/nonexistent/splits")


def test_fast_path_exact_across_input_splits(spark):
    tmp = tempfile.mkdtemp()
    games_txt = "".join(f'[Event "g{i}"]\n[WhiteElo "1500"]\n[BlackElo "1400"]\n\n1. e4 e5 2. Nf3 {i % 7} 1-0\n\n'
                        for i in range(3000))
    _write(tmp, "big.pgn", games_txt)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = pgn.scan_pgn_games(spark, tmp)
        assert df.rdd.getNumPartitions() > 5
        rows = df.select("game_text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    names = sorted(int(r.game_text.split('"')[1][1:]) for r in rows)
    assert names == list(range(3000))
    assert all(r.game_text.startswith('[Event "g') for r in rows)

"""Appending once, records that are no UTF-8, Python's line ends, and the first n games."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fianchetto.operators import framing, games
from fianchetto.sinks import writers
from fianchetto.sources import pgn, runs
from fianchetto.streaming import ingest
from tests.test_streaming import _write


def test_repeated_and_overlapping_appends_add_nothing(spark):
    path = tempfile.mkdtemp() + "/t"
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (None, 0, "c"), (1, 0, "again")], "run int, epoch int, value string")
    assert writers.append_once(rows, path, ["run", "epoch"]) == 3
    assert writers.append_once(rows, path, ["run", "epoch"]) == 0
    more = spark.createDataFrame([(1, 1, "late"), (2, 0, "d"), (None, 0, "e")], "run int, epoch int, value string")
    assert writers.append_once(more, path, ["run", "epoch"]) == 1
    got = spark.read.parquet(*writers.committed(spark, path))
    assert sorted((r.run or 0, r.epoch) for r in got.collect()) == [(0, 0), (1, 0), (1, 1), (2, 0)]
    assert writers.append_once(rows.limit(0), path, ["run", "epoch"]) == 0


def test_what_a_cut_off_append_left_is_not_read(spark):
    path = tempfile.mkdtemp() + "/t"
    log = spark.createDataFrame([(1, e, 0.5, 0.25) for e in range(3)], "run int, epoch int, train_mae double, val_mae double")
    writers.append_log(log.where("epoch < 2"), path)
    # data without their entry in the manifest, as after a crash in between
    writers.format_log(log).select("run", "epoch", "value").write.parquet(f"{path}/commit=lost")
    assert runs.read_log_table(spark, path).count() == 2
    assert writers.append_log(log, path) == 1
    assert sorted(r.epoch for r in runs.read_log_table(spark, path).collect()) == [0, 1, 2]


def test_configs_without_a_run_are_told_apart_by_their_id(spark):
    path = tempfile.mkdtemp() + "/c"
    cfg = spark.createDataFrame([("a", "lstm"), ("b", "transformer")], "run_id string, model string")
    assert writers.write_run_config(cfg, path) == 2 and writers.write_run_config(cfg, path) == 0
    assert {r.run_id: r.model for r in runs.read_run_configs(spark, path, multi_line=False).collect()} == {"a": "lstm", "b": "transformer"}


GAME = '[Event "g{i}"]\n[White "{w}"]\n[WhiteElo "1500"]\n[BlackElo "1400"]\n[Result "1-0"]\n\n1. e4 e5 2. Nf3 Nc6 1-0\n\n'


def test_bytes_that_are_no_utf8_are_a_status(spark):
    src = tempfile.mkdtemp()
    with open(f"{src}/a.pgn", "wb") as f:
        f.write(GAME.format(i=0, w="Müller").encode() + GAME.format(i=1, w="M?ller").encode().replace(b"?", b"\xfc") + GAME.format(i=2, w="x").encode())
    for recs in (pgn.scan_pgn_games(spark, src), framing.frame_games(pgn.scan_pgn_lines(spark, src))):
        assert {r.parse_status: r.n_games for r in games.reject_counts(games.parse_games(recs)).collect()} == {"ok": 2, "bad_utf8": 1}


@pytest.mark.parametrize("text", ["a\x0bb\x0cc\n", "a\x1cb\x1dc\x1ed\n", "x\x85y z \n", "\x0b\n", "\x0b\x0b\nq\n", "plain\n\nend\n", "é  ü\n"])
def test_lines_end_where_python_ends_them(spark, text):
    src = tempfile.mkdtemp()
    with open(os.path.join(src, "a.pgn"), "w", newline="") as f:
        f.write(text)
    lines = pgn.with_line_order(pgn.scan_pgn_lines(spark, src, python_lines=True)).orderBy("ln")
    assert [r.line for r in lines.collect()] == text.splitlines()
    assert [r.line for r in pgn.scan_pgn_lines(spark, src).orderBy("ln").collect()] == text.removesuffix("\n").split("\n")


def test_first_games_and_only_their_files_are_parsed(spark):
    rows = [(f"f{f}", ln, f * 100 + ln) for f in range(4) for ln in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "file string, first_ln long, game_id int").repartition(5)
    for n in (1, 19, 20, 21, 47, 79, 80, 81, 1000):
        got = games.max_games(df, n, chunk_records=7)
        assert sorted(r.game_id for r in got.collect()) == sorted(r[2] for r in rows)[:n]
    assert games.max_games(df, 0) is df and games.max_games(df.limit(0), 3).count() == 0
    parsed = df.withColumn("costly", F.explode(F.array(F.col("game_id") * 2)))
    plan = games.max_games(parsed, 21)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Filter")         # the filter stands below the costly step


def test_totals_by_batch_survive_a_resume_and_a_repeated_batch(spark):
    src, out, ck = (tempfile.mkdtemp() for _ in range(3))
    for i in range(3):
        _write(src, f"f{i}.pgn", 4, 4 * i)
    first = ingest.stream_games(spark, src, out, ck, stats_dir=out + "/../" + os.path.basename(out) + "-s")
    with open(f"{src}/bad.pgn", "w") as f:
        f.write(GAME.format(i=99, w="x").replace('"1500"', '"?"') + GAME.format(i=100, w="y"))
    second = ingest.stream_games(spark, src, out, ck, stats_dir=out + "-s")
    assert (first["records"], first["games"], first["statuses"]) == (12, 12, {"ok": 12})
    assert (second["records"], second["games"], second["statuses"]) == (2, 1, {"ok": 1, "bad_elo": 1})
    stats = {r.batch: r for r in ingest.ingest_stats(spark, out + "-s").collect()}
    assert sorted(stats) == [0, 1, 2, 3] and stats[3].statuses == {"ok": 1, "bad_elo": 1}
    assert ingest.ingest_totals(spark, out + "-s")["games"] == spark.read.parquet(out).count() == 13
    assert ingest.ingest_totals(spark, out + "-none") == {"records": 0, "games": 0, "statuses": {}}

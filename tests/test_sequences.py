"""The batch encoder against the scalar board functions, on boards good and bad."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fianchetto.functions.fen import board_onehot_indices
from fianchetto.operators import positions
from fianchetto.operators.model import dataset_pipeline
from fianchetto.plans.bindings import FEN_POOL


def _random_fens(n):
    rng = random.Random(5)
    out = [*FEN_POOL, "", " w", "/", "////////", "é7/8 b", "8/🙂/8 w", "k²6 w", "①", "9/8/8/8/8/8/8/8/9 w", "pppppppp1/8 w", "p\nq/8 w"]
    for _ in range(n):
        ranks = ["".join(rng.choice("pnbrqkPNBRQK12345678.x0") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))]
        out.append("/".join(ranks) + rng.choice(["", " w", " b - -"]))
    return out


def test_encoder_equals_the_scalar_functions(spark):
    fens = _random_fens(1500)
    exp = [r.x for r in spark.createDataFrame([(i, f) for i, f in enumerate(fens)], "i int, fen string")
           .select("i", F.coalesce(board_onehot_indices("fen"), F.array().cast("array<int>")).alias("x")).orderBy("i").collect()]
    entry, lists = positions.board_dictionary(pa.array([*fens, None], pa.string()))
    got = lists.take(pa.array(entry)).to_pylist()
    assert got == [*exp, []]
    assert len(lists) == len(set(fens)) + 1     # each distinct FEN once, and the empty entry


def test_boards_equal_the_scalar_functions(spark):
    from fianchetto.functions import fen as S

    fens = [*_random_fens(600), None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fens)], "i int, fen string").withColumn("valid", F.lit("clash"))
    got = positions.with_board(df).select("i", "valid", "board_codes", "onehot_idx", "features").orderBy("i").collect()
    exp = df.select("i", S.board_valid("fen").alias("valid"), S.board_codes("fen").alias("board_codes"), S.board_onehot_indices("fen").alias("onehot_idx"),
                    S.fen_features("fen").alias("features")).orderBy("i").collect()
    assert got == exp and sum(not r.valid for r in got) > 50
    assert positions.with_board(df, columns=("features",)).columns == ["i", "fen", "valid", "features"]
    assert positions.with_board(df.limit(0)).collect() == []


def test_sequences_of_every_shape(spark):
    pool = _random_fens(40)
    rows = [(1, None), (2, []), (3, [None, pool[0], None]), (4, pool * 6), (5, [pool[1]] * 9), (1, [pool[4]])]
    df = spark.createDataFrame(rows, "game_id long, fens array<string>").withColumns({"seq": F.lit("clash"), "length": F.lit("clash")})
    got = positions.encode_sequence(df, max_len=7).collect()
    assert [(r.game_id, r.length) for r in got] == [(1, 0), (2, 0), (3, 3), (4, 7), (5, 7), (1, 1)]
    assert all(len(r.seq) == 7 for r in got) and got[2].seq[0] == got[2].seq[2] == [] and len(got[2].seq[1]) == 32
    assert got[4].seq[0] == got[4].seq[6] and [r.fens for r in got] == [f for _, f in rows]
    assert positions.encode_sequence(df.limit(0)).collect() == []
    assert "fens" not in positions.encode_sequence(df, keep_fens=False).columns


@pytest.mark.parametrize("step", [1, 512])
def test_steps_do_not_change_results(spark, monkeypatch, step):
    table = pa.table({"game_id": [1, 2, 3], "fens": pa.array([[FEN_POOL[0]], None, FEN_POOL[:5]], pa.list_(pa.string()))})
    monkeypatch.setattr(positions, "GAMES_PER_STEP", step)
    out = pa.Table.from_batches(list(positions._sequence_encoder("fens", 4, ["game_id"])(table.to_batches())))
    assert out.column("length").to_pylist() == [1, 0, 4]
    assert [len(s[0]) for s in out.column("seq").to_pylist()] == [32, 0, 32]


def test_a_sample_for_every_epoch(spark):
    df = spark.createDataFrame([(i, "train" if i < 40 else "val", i % 40, [FEN_POOL[i % 16]] * (i % 5), 1000 + i, 2000, "1-0") for i in range(50)],
                               "game_id long, split string, split_rk long, fens array<string>, white_elo int, black_elo int, result string")
    d = dataset_pipeline(df, epochs=(0, 1, 2), max_len=3)
    assert d.columns == ["game_id", "seq", "length", "elo", "white_elo", "black_elo", "result", "split", "split_rk", "epoch", "batch_id", "batch_pos"]
    assert d.groupBy("game_id").count().where("count = 3").count() == 50
    val = d.where("split = 'val'").collect()
    assert all(r.batch_id == r.split_rk // 32 and len(r.seq) == 3 and r.length == min(3, r.game_id % 5) for r in val)


def test_onehot_text_and_batch_bounds(spark):
    """The indices as text are those of the list; narrow rows are bounded in rows alone, wide ones in bytes too."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    fens = [*_random_fens(300), None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fens)], "i int, fen string")
    got = positions.with_board(df, columns=("onehot_idx", "onehot_text"))
    assert int(spark.conf.get(limit)) == (1 << 31) - 1
    rows = got.collect()
    assert [r.onehot_text for r in rows] == [None if r.onehot_idx is None else ",".join(map(str, r.onehot_idx)) for r in rows]
    assert sum(r.onehot_text is None for r in rows) > 20 and "" in [r.onehot_text for r in rows]
    assert positions.with_board(df, columns=("onehot_text",)).columns == ["i", "fen", "onehot_text"]
    bare = positions.with_board(df, columns=("onehot_text",), keep_fen=False)
    assert bare.collect() == [(r.i, r.onehot_text) for r in rows]
    positions.with_board(df.withColumn("more", F.array("fen")))
    assert int(spark.conf.get(limit)) <= 8 << 20
    positions.with_board(df)
    positions.encode_sequence(df.groupBy("i").agg(F.collect_list("fen").alias("fens")))
    assert int(spark.conf.get(limit)) <= 8 << 20

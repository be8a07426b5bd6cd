"""The encoder on bytes against the scalar rules, and the digest that the worker makes of a sequence."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fianchetto.operators import positions
from fianchetto.plans import bindings as B
from fianchetto.plans import catalog
from tests.conftest import SMALL
from tests.test_sequences import _random_fens

ODD = ["", " ", "  w", "/", "k", "k w", "K/", "/K", "pppppppp/pppppppp", "7kk/8", "0k0/0", "44k/8", "9", "9k", "k//k", "8/8/8/8/8/8/8/8/", "k" * 9,
       "8/8/8/8/8/8/8/8/k", "9" * 40 + "k", "1" * 300 + "/k", "K" + "/" * 300, "/" * 300 + "K", "Kk²", "k\tq", "é", "pppppppp/" * 7 + "PPPPPPPP"]


@pytest.mark.parametrize("step", [1, 7, 4096])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_bytes_equal_signs(monkeypatch, step, kind):
    monkeypatch.setattr(positions, "FENS_PER_STEP", step)
    fens = [*_random_fens(700), *ODD]
    _, square, code, bad = (made := positions._pieces([f.split(" ", 1)[0] for f in fens]))
    exp = [[] for _ in fens]
    for b, s, c in zip(made[0], square, code, strict=True):
        exp[b].append(c * 64 + s)
    assert bad.sum() > 50
    entry, lists = positions.board_dictionary(pa.array(["cut", *fens, None, "cut"], kind)[1:-1])
    assert lists.take(pa.array(entry)).to_pylist() == [*map(sorted, exp), []]


def test_no_fens():
    entry, lists = positions.board_dictionary(pa.array([None, None], pa.string()))
    assert entry.tolist() == [0, 0] and lists.to_pylist() == [[]]
    assert len(positions.board_dictionary(pa.array([], pa.string()))[0]) == 0


def test_md5_of_slots():
    seq = [[[0, 831], [], [7]], [], [[]], [[], [], []], [[64]], [[], [5, 60, 700]]]
    exp = [hashlib.md5(";".join(",".join(map(str, s)) for s in q).encode()).hexdigest() for q in seq]
    array = pa.array(seq, pa.list_(pa.list_(pa.int32())))
    assert positions.sequence_md5(array) == exp and positions.sequence_md5(array[2:5]) == exp[2:5] and positions.sequence_md5(array[:0]) == []


@pytest.mark.parametrize("max_len", [0, 1, 7, 200])
def test_digest_equals_that_of_the_column(spark, max_len):
    pool = [*_random_fens(60), *ODD]
    rows = [(1, None), (2, []), (3, [None, pool[0], None]), (4, pool * 3), (5, [pool[1]] * 9), (6, [pool[8]]), *((i, pool[i : i + 90]) for i in range(7, 30))]
    df = spark.createDataFrame(rows, "game_id long, fens array<string>").withColumn("seq_md5", F.lit("clash"))
    got = positions.encode_sequence(df, max_len=max_len, digest=True)
    assert got.columns == ["game_id", "fens", "seq", "length", "seq_md5"]
    assert got.where(F.col("seq_md5") != catalog._seq_digest()).count() == 0 and got.where("seq_md5 IS NULL").count() == 0
    assert "seq_md5" in positions.encode_sequence(df).columns      # not asked for: the caller's own


@pytest.mark.parametrize("query", [catalog.q_encode_sequence, catalog.q_build_samples])
def test_text_of_sequences_is_not_made_by_expressions(spark, query):
    plan = query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "to_json" not in plan and "filter(seq" not in plan and "aggregate(seq" not in plan


@pytest.mark.parametrize("query", [catalog.q_encode_sequence, catalog.q_build_samples])
def test_games_stay_in_many_parts(spark, query):
    """A few bytes an order are up to 251 positions: they are not merged to a task or two a core."""
    df = query(spark, SMALL)
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and df.count() == B.games_b1(spark, SMALL).count()


def test_fens_come_round(spark):
    got = B.fens_b2(spark, SMALL).join(B.games_b1(spark, SMALL).select("game_id", "n_ply"), "game_id").collect()
    assert {r.n_ply % 16 for r in got} == set(range(16))
    assert all(r.fens == [B.FEN_POOL[(r.game_id * 7 + p * 13) % 16] for p in range(r.n_ply + 1)] for r in got)


def test_fens_of_any_number(spark):
    games = spark.createDataFrame([(g, n) for g in (0, 5, 31) for n in (0, 15, 16, 254, 255, 256, 257, 600)], "game_id long, n_ply int")
    got = B.with_fens(games.withColumn("n", F.col("n_ply"))).collect()
    assert len(got) == 24 and all(r.fens == [B.FEN_POOL[(r.game_id * 7 + p * 13) % 16] for p in range(r.n + 1)] for r in got)


def test_samples_with_their_digest(spark):
    df = B.fens_b2(spark, SMALL).limit(40)
    got = positions.build_samples(df, max_len=9, digest=True)
    assert got.columns == ["game_id", "seq", "length", "seq_md5", "elo", "white_elo", "black_elo", "result"]
    assert got.where(F.col("seq_md5") == catalog._seq_digest()).count() == 40
    assert "seq_md5" not in positions.build_samples(df, max_len=9).columns


def test_workers_talk_over_unix_sockets(spark):
    def env(batches):
        import os

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"uds": [os.environ.get("PYTHON_UNIX_DOMAIN_ENABLED")]})

    assert {r.uds for r in spark.range(8).mapInArrow(env, "uds string").collect()} == {"True"}

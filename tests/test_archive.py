"""The two end-to-end jobs on a small compressed archive written by the test."""

import os
import random
import tempfile

import zstandard

from fianchetto.plans import archive
from fianchetto.plans.bindings import MOVETEXTS


def _archive(n=300, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        we, be = rnd.randint(800, 2800), rnd.randint(800, 2800)
        res = rnd.choice(["1-0", "0-1", "1/2-1/2"])
        white = "" if i % 29 == 0 else f'[WhiteElo "{we}"]\n'
        out.append(f'[Event "Rated game"]\n[Site "t/{i}"]\n[Result "{res}"]\n{white}[BlackElo "{be}"]\n\n'
                   f'{MOVETEXTS[i % len(MOVETEXTS)]} {res}\n\n')
    return out


def test_preprocess_then_train(spark):
    src, out, res = tempfile.mkdtemp(), tempfile.mkdtemp(), tempfile.mkdtemp()
    gs = _archive()
    with open(os.path.join(src, "dump.pgn"), "w") as f:
        f.write("".join(gs[:150]))
    with open(os.path.join(src, "dump2.pgn.zst"), "wb") as f:
        f.write(zstandard.ZstdCompressor().compress("".join(gs[150:]).encode()))
    stats = archive.preprocess_archive(spark, src, out, replay_moves=True)
    assert spark.read.parquet(os.path.join(out, "positions")).count() > 300
    n_missing = len([i for i in range(300) if i % 29 == 0])
    assert sum(stats["splits"].values()) == 300 - n_missing
    assert stats["rejects"]["missing_header"] == n_missing
    assert stats["splits"]["train"] == int((300 - n_missing) * 0.8)
    r = archive.train_and_evaluate(spark, out, res)
    assert 0 <= r["test"]["mae"] <= 1 and r["history"]["epoch"] == 0
    assert os.path.exists(os.path.join(res, "report")) and os.path.exists(os.path.join(res, "model"))


def test_preprocess_reference_mode(spark):
    src, out = tempfile.mkdtemp(), tempfile.mkdtemp()
    with open(os.path.join(src, "dump.pgn"), "w") as f:
        f.write("".join(_archive(100, seed=9)))
    stats = archive.preprocess_archive(spark, src, out, mode="reference")
    assert sum(stats["splits"].values()) == 100 - len([i for i in range(100) if i % 29 == 0])


def test_identity_does_not_depend_on_splits_or_place(spark):
    """One archive, read with few and many input splits and from another folder: the
    same ids and the same split."""
    from fianchetto.operators import games, split
    from fianchetto.sources import pgn

    seen = []
    for size in (None, "4k", "1k"):
        src = os.path.join(tempfile.mkdtemp(), f"moved-{size}")
        os.makedirs(os.path.join(src, "2013"))
        for name in ("a.pgn", "2013/b.pgn"):
            with open(os.path.join(src, name), "w") as f:
                f.write("% preamble\n\n" + "".join(_archive(120, seed=len(name))))
        kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size or kept)
        try:
            recs = pgn.scan_pgn_games(spark, src)
            sp = split.split_exact(games.valid_games(games.parse_games(recs)).select("game_id", "file", "first_ln"), materialize=True)
            seen.append(sorted((r.file, r.first_ln, r.game_id, r.split, r.rk) for r in sp.collect()))
            lines = pgn.scan_pgn_lines(spark, src).where("file = 'a.pgn'").orderBy("ln").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        with open(os.path.join(src, "a.pgn")) as f:
            assert [(r.ln, r.line) for r in lines] == list(enumerate(f.read().split("\n")[:-1]))
    assert seen[0] == seen[1] == seen[2] and len({x[2] for x in seen[0]}) == len(seen[0]) > 200
    assert {x[0] for x in seen[0]} == {"a.pgn", "2013/b.pgn"}


def test_max_games_in_archive_order(spark):
    from fianchetto.operators import games

    rows = [(f"f{i % 5}", i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "file string, first_ln long, k int").repartition(7)
    want = [k for _, _, k in sorted(rows)]
    for n in (1, 39, 40, 41, 100, 500):
        got = games.max_games(df, n, chunk_records=16).orderBy("file", "first_ln").collect()
        assert [r.k for r in got] == want[:n]
    assert games.max_games(df, 0).count() == 200

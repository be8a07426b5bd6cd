"""Streaming forms: resume from checkpoint, keyed early-stop state across batches."""

import tempfile

from pyspark.sql import functions as F

from fianchetto.operators import history
from fianchetto.streaming import ingest
from tests.test_history import NAN, _hist, _losses

GAME = ('[Event "g{i}"]\n[Site "s{i}"]\n[WhiteElo "1500"]\n[BlackElo "1400"]\n[Result "1-0"]\n\n'
        '1. e4 e5 2. Nf3 Nc6 1-0\n\n')


def _write(d, name, n, start):
    with open(f"{d}/{name}", "w") as f:
        f.write("".join(GAME.format(i=i) for i in range(start, start + n)))


def test_stream_games_resumes(spark):
    src, out, ck = (tempfile.mkdtemp() for _ in range(3))
    _write(src, "a.pgn", 5, 0)
    s1 = ingest.stream_games(spark, src, out, ck, replay_moves=True)
    assert s1["games"] == 5
    _write(src, "b.pgn", 3, 5)
    s2 = ingest.stream_games(spark, src, out, ck, replay_moves=True)      # only the new file is read
    assert s2["games"] == 3
    g = spark.read.parquet(out)
    assert g.count() == 8 and g.select(F.size("fens")).distinct().collect()[0][0] == 5


def test_stream_early_stop_state(spark):
    _, df = _hist(spark, seed=11, runs=6, epochs=20)
    df = df.unionByName(_losses(spark, *[[NAN] + [0.5] * 9] * 7).where("run = 6"))
    src, out, ck = (tempfile.mkdtemp() for _ in range(3))
    for part in (F.col("epoch") > 13, F.col("epoch") < 7, F.col("epoch").between(7, 13)):  # any order
        df.where(part).write.mode("append").parquet(src)
    got = sorted(map(tuple, ingest.stream_early_stop(spark, src, df.schema, out, ck).collect()))
    batch = history.early_stop(df).where("stop_epoch IS NOT NULL").select("run", "stop_epoch", "best_loss")
    assert repr(got) == repr(sorted(map(tuple, batch.collect()))) and got[-1][:2] == (6, 5)


def test_totals_beyond_kept_progress(spark):
    src, out, ck = (tempfile.mkdtemp() for _ in range(3))
    for i in range(8):
        _write(src, f"f{i}.pgn", 2, 2 * i)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", 2)
    try:
        assert ingest.stream_games(spark, src, out, ck)["games"] == 16
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)


def test_stream_games_reference_mode_matches_batch(spark):
    from fianchetto.operators import framing, games
    from fianchetto.sources import pgn
    from tests.test_pgn import GAMES
    src, out, ck = (tempfile.mkdtemp() for _ in range(3))
    text = GAMES.replace('[WhiteElo "1500"]', '[WhiteElo "1500"]\n[BlackElo "1400"]') + "\n\n"
    for i in range(3):
        with open(f"{src}/f{i}.pgn", "w") as f:
            f.write(text)
    s = ingest.stream_games(spark, src, out, ck, mode="reference")
    batch = games.valid_games(games.parse_games(
        framing.frame_games(pgn.scan_pgn_lines(spark, src), mode="reference")))
    # per file: a; b (no moves) glued to c and lost with it; d -> 2 games
    assert s["last_batch"] == 2 and s["games"] == batch.count() == 6
    assert spark.read.parquet(out).count() == 6


def test_keyed_early_stop_equals_batch_at_every_trigger(spark):
    """Shuffled epochs with gaps over many triggers and a restart; the state holds early arrivals only."""
    _, df = _hist(spark, seed=4, runs=8, epochs=25)
    df = df.where((F.col("run") * 5 + F.col("epoch")) % 11 > 0)        # gaps that are never filled
    src, out, ck = (tempfile.mkdtemp() for _ in range(3))
    seen = None
    for part in (3, 0, 4, 1, 2):
        now = df.where((F.col("epoch") * 3 + F.col("run")) % 5 == part)
        now.coalesce(1).write.mode("append").parquet(src)
        seen = now if seen is None else seen.unionByName(now)
        got = sorted(map(tuple, ingest.stream_early_stop(spark, src, df.schema, out, ck, patience=3, min_delta=0.01).collect()))
        batch = history.early_stop(seen, 3, 0.01).where("stop_epoch IS NOT NULL").select("run", "stop_epoch", "best_loss")
        assert repr(got) == repr(sorted(map(tuple, batch.collect())))


def test_early_arrivals_wait_for_their_turn(spark):
    df = _losses(spark, [0.5, 0.6, 0.7, 0.8, 0.9, 0.4])
    src, out, ck = (tempfile.mkdtemp() for _ in range(3))
    waiting = []
    for part in ("epoch >= 3", "epoch = 1", "epoch = 0", "epoch = 2", "epoch = 1"):        # the last one again
        df.where(part).coalesce(1).write.mode("append").parquet(src)
        stops = ingest.stream_early_stop(spark, src, df.schema, out, ck, patience=4).collect()
        last = spark.read.parquet(out).orderBy(F.desc("batch")).first()
        waiting.append((last.waiting, last.epochs_seen))
    assert waiting == [(3, 3), (4, 4), (3, 5), (0, 6), (0, 6)] and [tuple(r)[1:] for r in stops] == [(4, 0.5)]


def test_python_is_called_once_a_bucket_of_runs(spark):
    """Many runs in few buckets, a run without a name among them; states of a bucket stay apart."""
    _, df = _hist(spark, seed=9, runs=40, epochs=12)
    df = df.unionByName(df.where("run = 3").withColumn("run", F.lit(None).cast(df.schema["run"].dataType)))
    src, out, ck = (tempfile.mkdtemp() for _ in range(3))
    for part in (F.col("epoch") % 2 == 1, F.col("epoch") % 2 == 0):
        df.where(part).coalesce(1).write.mode("append").parquet(src)
        stops = ingest.stream_early_stop(spark, src, df.schema, out, ck, patience=2, min_delta=0.01, buckets=3)
    batch = history.early_stop(df, 2, 0.01).where("stop_epoch IS NOT NULL").select("run", "stop_epoch", "best_loss")
    key = lambda r: (r[0] is None, r)
    got, want = (sorted(map(tuple, x.collect()), key=key) for x in (stops, batch))
    assert repr(got) == repr(want) and len(want) > 3

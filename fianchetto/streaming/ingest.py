"""Structured Streaming forms.

* ``stream_games``: PGN files arriving in a folder -> framed, parsed, filtered,
  replayed games appended to Parquet, with a checkpoint for exactly-once resume
  (the original only pickled snapshots it never read back).
* ``stream_weighted_mean``: the running-average meter as a streaming aggregate.
* ``ingest_stats``: observed totals of ``stream_games``, one row per micro-batch.
* ``stream_early_stop``: early stopping over a stream of history rows with state by
  run, by the same rule as in batch (``history.early_stop``).
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fianchetto.constants import EARLY_STOP_MIN_DELTA, EARLY_STOP_PATIENCE
from fianchetto.operators import framing, games, replay
from fianchetto.sources.pgn import scan_pgn_games


def _run(query, timeout_s: float | None):
    """Wait for the query, without a limit unless the caller sets one."""
    query.awaitTermination(timeout_s)
    if query.isActive:
        query.stop()
        raise TimeoutError("stream did not finish in time")
    if query.exception():
        raise query.exception()
    return query


def stream_games(spark: SparkSession, source_dir: str, output_dir: str, checkpoint_dir: str,
                 max_files_per_trigger: int = 1, replay_moves: bool = False,
                 repartition: int | None = None, timeout_s: float | None = None,
                 mode: str = "clean", stats_dir: str | None = None) -> dict:
    """Ingest every PGN file now in ``source_dir`` (``availableNow``), one
    micro-batch per ``max_files_per_trigger`` files.  Re-running with the same
    checkpoint only processes new files.  A batch writes its games to
    ``output_dir/batch=N`` and its totals to ``stats_dir`` (by default ``output_dir``
    with ``-stats``; see ``ingest_stats``), so a batch that is retried counts once.
    Returns this call's totals: the last batch's number, records, games written,
    records by status, and the rate.

    A plain-text file is split by the reader; a compressed one is one task, so
    with few large compressed files per trigger pass ``repartition`` to spread
    parsing and replay over the cores.

    ``mode='reference'`` applies the original blank-line framing: every
    micro-batch holds whole files, so the exact line framing runs inside it."""
    if mode == "reference":
        lines = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger)
                 .option("recursiveFileLookup", True)
                 .load(source_dir).select(F.col("_metadata.file_path").alias("file"),
                                          F.col("value").alias("line")))

        def records(batch_df):
            # a static frame: line order within each file is the scan order; the
            # framing's twice-read intermediates are checkpointed (shared folder)
            numbered = batch_df.withColumn("ln", F.monotonically_increasing_id())
            return games.parse_games(framing.frame_games(numbered, mode="reference", materialize=True))

        return _ingest(lines, records, output_dir, checkpoint_dir, stats_dir, replay_moves, timeout_s)
    recs = scan_pgn_games(spark, source_dir, stream=True, max_files_per_trigger=max_files_per_trigger)

    def records(batch_df):
        dealt = batch_df.repartition(repartition) if repartition else batch_df
        dealt = dealt.withColumn("first_ln", F.lit(0).cast("long")).withColumn("game_id", F.xxhash64("file", "game_text"))
        return games.parse_games(dealt, id_col="game_id").drop("first_ln")

    return _ingest(recs, records, output_dir, checkpoint_dir, stats_dir, replay_moves, timeout_s)


STATS = "records long, games long, statuses map<string,bigint>, seconds double, batch long"


def _ingest(source: DataFrame, records, output_dir: str, checkpoint_dir: str, stats_dir: str | None,
            replay_moves: bool, timeout_s: float | None) -> dict:
    """Run ``source`` to its end; ``records`` parses a micro-batch.  A batch writes its games and then its row of the
    totals, each to a folder of its own: a batch that is run again replaces both."""
    spark = source.sparkSession
    stats_dir = stats_dir or output_dir.rstrip("/") + "-stats"
    began, before = time.time(), ingest_totals(spark, stats_dir)

    def per_batch(batch_df, batch_id):
        started = time.time()
        # counted while the games are written, by no pass of their own
        seen, kept = Observation("records"), Observation("games")
        parsed = records(batch_df).observe(seen, F.count(F.lit(1)).alias("records"),
                                           *[F.count_if(F.col("parse_status") == s).alias(s) for s in games.STATUSES])
        out = games.valid_games(parsed).drop("game_text")
        if replay_moves:
            out = replay.finalize_games(replay.replay_games(out))
        out = out.observe(kept, F.count(F.lit(1)).alias("games"))
        out.write.mode("overwrite").parquet(f"{output_dir}/batch={batch_id}")
        n, statuses = kept.get["games"], dict(seen.get)
        row = (statuses.pop("records"), n, {s: k for s, k in statuses.items() if k}, time.time() - started)
        (batch_df.sparkSession.createDataFrame([row], STATS.rsplit(",", 1)[0]).coalesce(1)
         .write.mode("overwrite").parquet(f"{stats_dir}/batch={batch_id}"))

    q = (source.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    _run(q, timeout_s)
    after, secs = ingest_totals(spark, stats_dir), time.time() - began
    written = after["games"] - before["games"]
    return {"last_batch": (q.lastProgress or {}).get("batchId"), "games": written, "records": after["records"] - before["records"],
            "statuses": {s: n - before["statuses"].get(s, 0) for s, n in after["statuses"].items() if n > before["statuses"].get(s, 0)},
            "games_per_sec": written / secs if secs else None}


def ingest_stats(spark: SparkSession, stats_dir: str) -> DataFrame:
    """One row per micro-batch of ``stream_games``: batch, records, games (written), statuses (records by parse status)
    and seconds.  Readable while the stream runs; empty before its first batch."""
    return spark.read.schema(STATS).parquet(stats_dir).select("batch", "records", "games", "statuses", "seconds")


def ingest_totals(spark: SparkSession, stats_dir: str) -> dict:
    """records, games and statuses summed over all batches so far."""
    try:
        stats = ingest_stats(spark, stats_dir)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {"records": 0, "games": 0, "statuses": {}}
    total = stats.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("r"), F.coalesce(F.sum("games"), F.lit(0)).alias("g")).first()
    by_status = stats.select(F.explode("statuses").alias("s", "n")).groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {"records": total.r, "games": total.g, "statuses": {r.s: r.n for r in by_status}}


def stream_weighted_mean(spark: SparkSession, source_dir: str, schema: T.StructType, output_dir: str,
                         checkpoint_dir: str, group_by=("run",), value: str = "loss",
                         weight: str = "n", max_files_per_trigger: int = 1,
                         timeout_s: float | None = None) -> DataFrame:
    """``sum(v*n)/sum(n)`` per group over a stream of batch logs (complete mode).
    Each micro-batch writes the whole current table to a folder of its own, and the
    last one is returned: a crash in between leaves the one before intact."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    v, n = F.col(value), F.col(weight)
    agg = src.groupBy(*group_by).agg((F.sum(v * n) / F.sum(n)).alias("mean"),
                                     F.sum(v * n).alias("total"), F.sum(n).alias("weight"))

    def sink(batch_df, batch_id):
        batch_df.write.mode("overwrite").parquet(f"{output_dir}/batch={batch_id}")

    q = (agg.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    _run(q, timeout_s)
    tables = spark.read.parquet(output_dir)
    return tables.where(F.col("batch") == tables.agg(F.max("batch")).scalar()).drop("batch")


#: Groups of runs whose early-stop states are kept together.
STOP_BUCKETS = 1024


def stream_early_stop(spark: SparkSession, source_dir: str, schema: T.StructType, output_dir: str,
                      checkpoint_dir: str, patience: int = EARLY_STOP_PATIENCE,
                      min_delta: float = EARLY_STOP_MIN_DELTA, timeout_s: float | None = None,
                      max_files_per_trigger: int = 1, first_epoch: int = 0, buckets: int = STOP_BUCKETS) -> DataFrame:
    """Runs that stop (run, stop_epoch, best_loss) over newly arrived history rows (run, epoch, val_loss).

    State is kept by run: the best loss, the epochs without improvement, the stop and the next epoch, all of which follow
    the batch rule, and the epochs that came before their turn.  An epoch is folded for good once all before it are;
    at each trigger a run's verdict is that of the folded epochs and, after them, the waiting ones in order, so
    epochs may arrive in any order, and gaps that are never filled do no harm.  No row is read twice: each trigger writes the
    verdicts of the runs it touched, and the last one of a run counts.  An epoch that has been folded is not
    folded again.  Runs are dealt into ``buckets`` whose states are kept together: a trigger calls Python once a bucket, not once
    a run.  A checkpoint belongs to one number of buckets; for many millions of runs take more."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
           .select(F.col("run").cast("long").alias("run"), F.col("epoch").cast("int").alias("epoch"), F.col("val_loss").cast("double").alias("val_loss"))
           # pandas would make floats of a column with NULLs
           .where("epoch IS NOT NULL").select(F.coalesce("run", F.lit(0)).alias("run"), F.col("run").isNotNull().alias("named"), "epoch", "val_loss",
                                              F.pmod(F.xxhash64("run"), F.lit(buckets)).alias("bucket")))
    verdicts = src.groupBy("bucket").applyInPandasWithState(
        _keyed_stop(patience, min_delta, first_epoch), VERDICT, STOP_STATE, "update", "NoTimeout")

    def sink(batch_df, batch_id):
        batch_df.write.mode("overwrite").parquet(f"{output_dir}/batch={batch_id}")

    q = (verdicts.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    _run(q, timeout_s)
    latest = (spark.read.schema(VERDICT + ", batch long").parquet(output_dir)
              .groupBy("run").agg(F.max_by(F.struct("stop_epoch", "best", "best_is_nan"), "batch").alias("v")))
    best = F.when(F.col("v.best_is_nan"), F.lit(float("nan"))).otherwise(F.col("v.best"))
    return latest.select("run", "v.stop_epoch", best.alias("best_loss")).where("stop_epoch IS NOT NULL")


VERDICT = "run long, stop_epoch int, best double, best_is_nan boolean, epochs_seen int, waiting int"
#: One entry a run in each of the first arrays, one an early arrival in the last three.
STOP_STATE = ("runs array<bigint>, named array<boolean>, started array<boolean>, best array<double>, bad array<int>, stop array<int>, "
              "next array<int>, seen array<int>, early array<int>, epochs array<int>, losses array<double>")


def _keyed_stop(patience: int, min_delta: float, first_epoch: int):
    def fold(s, epoch, loss):
        """One epoch of the rule of ``history.early_stop``: s = (started, best, bad, stop)."""
        started, best, bad, stop = s
        if stop is not None:
            return s
        if not started or loss < best - min_delta:  # false with NaN on either side
            return True, loss, 0, None
        bad += 1
        return True, best, bad, epoch if bad >= patience else None

    def bucket(key, frames, state):
        import math

        import pandas as pd

        held = {}  # run -> [(started, best, bad, stop), next epoch, epochs seen, waiting]
        if state.exists:
            *runs, early, epochs, losses = state.get
            for run, named, started, best, bad, stop, following, seen in zip(*runs):
                held[run, named] = [(started, best, bad, stop), following, seen, {}]
            places = list(held.values())
            for at, epoch, loss in zip(early, epochs, losses):
                places[at][3][epoch] = loss
        touched = {}
        for frame in frames:
            for run, named, epoch, loss in zip(*(frame[c].tolist() for c in ("run", "named", "epoch", "val_loss"))):
                of = held.setdefault((run, named), [(False, 0.0, 0, None), first_epoch, 0, {}])
                touched[run, named] = of
                if epoch >= of[1] and epoch not in of[3]:
                    of[3][epoch] = loss
                    of[2] += 1
        verdicts = []
        for (run, named), of in touched.items():
            s, following, seen, waiting = of
            while following in waiting:
                s = fold(s, following, waiting.pop(following))
                following += 1
            verdict = s
            for epoch in sorted(waiting):
                verdict = fold(verdict, epoch, waiting[epoch])
            if s[3] is not None:  # after a stop nothing counts any more
                waiting = {}
            of[:] = s, following, seen, waiting
            verdicts.append((run if named else None, verdict[3], verdict[1], math.isnan(verdict[1]), seen, len(waiting)))
        early = [(at, epoch, of[3][epoch]) for at, of in enumerate(held.values()) for epoch in sorted(of[3])]
        state.update(tuple(map(list, [*zip(*((*name, *of[0], of[1], of[2]) for name, of in held.items())), *(zip(*early) if early else ((), (), ()))])))
        run, stop, best, is_nan, seen, waiting = zip(*verdicts)
        # pandas hands NaN over as NULL: whether the best loss is NaN goes by itself
        yield pd.DataFrame({"run": pd.array(run, "Int64"), "stop_epoch": pd.array(stop, "Int32"), "best": best, "best_is_nan": is_nan,
                            "epochs_seen": seen, "waiting": waiting})
    return bucket

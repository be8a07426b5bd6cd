"""Sinks (K1, K2, K4, K5, K6)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fianchetto.constants import LOG_ELO_SUFFIX, LOG_FORMAT


def write_games(games: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parsed games (and, separately, positions) as Parquet."""
    games.write.mode(mode).parquet(path)


def write_splits(split_df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One table partitioned by ``split``, so reading one split prunes the rest."""
    split_df.write.mode(mode).partitionBy("split").parquet(path)


def report_json(overall: DataFrame, segments: DataFrame) -> DataFrame:
    """One-row DataFrame with ``report`` = JSON ``{overall_metrics: {...},
    segmentation: {label: {range, count, mae, rmse}}}``.

    The segmentation (one row per band, a bounded list) becomes a map through a
    scalar subquery; no join is needed."""
    seg_map = segments.agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("label"), F.struct("range", "count", "mae", "rmse"))))).scalar()
    metric_cols = [c for c in overall.columns]
    return overall.select(F.to_json(F.struct(
        F.struct(*[F.col(c).cast("double").alias(c) for c in metric_cols]).alias("overall_metrics"),
        seg_map.alias("segmentation"))).alias("report"))


def write_report(overall: DataFrame, segments: DataFrame, path: str) -> None:
    report_json(overall, segments).coalesce(1).write.mode("overwrite").text(path)


COMMITS = "_commits"


def append_once(rows: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> int:
    """Append the rows whose ``keys`` are not in the table yet; returns how many there were.

    The data go to a folder ``commit=ID``, then their keys and that ID to the manifest ``_commits``, which readers
    (``committed``) follow: a call that is repeated adds nothing, and what a call that was cut off left behind is not
    read and does not hinder its repetition.  Of rows with equal keys one is kept; NULL is a key as any other.  One writer
    at a time: two at once may both add a key."""
    spark = rows.sparkSession
    commit = uuid.uuid4().hex
    new = rows.dropDuplicates(list(keys))
    done = _manifest(spark, path)
    if done is not None:
        same = reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
        new = new.alias("a").join(done.alias("b"), same, "left_anti")
    data = f"{path}/commit={commit}"
    new.write.format(fmt).save(data)
    schema = rows.schema
    written = spark.read.schema(schema).format(fmt).load(data).select(*keys, F.lit(commit).alias("commit"))
    written.write.mode("append").parquet(f"{path}/{COMMITS}")
    return spark.read.parquet(f"{path}/{COMMITS}").where(F.col("commit") == commit).count()


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{COMMITS}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def committed(spark: SparkSession, path: str) -> list[str] | None:
    """The data folders of a table written by ``append_once``, one per call that added rows; None for any other folder."""
    done = _manifest(spark, path)
    return None if done is None else [f"{path}/commit={r.commit}" for r in done.select("commit").distinct().collect()]


def write_run_config(configs: DataFrame, path: str, keys: Sequence[str] | None = None) -> int:
    """Append run configurations (one JSON object per line), with ``run_time`` (the
    time of the call, unless there) and ``run_id`` (its stamp YYYYmmdd_HHMMSS, unless
    there).  A configuration is written once: by ``keys``, which are ``run`` if there is such
    a column, else ``run_id``.  Returns how many were added."""
    keys = keys or (["run"] if "run" in configs.columns else ["run_id"])
    if "run_time" not in configs.columns:
        configs = configs.withColumn("run_time", F.current_timestamp())
    if "run_id" not in configs.columns:
        configs = configs.withColumn("run_id", F.date_format("run_time", "yyyyMMdd_HHmmss"))
    return append_once(configs, path, keys, "json")


def format_log(history: DataFrame, epoch: str = "epoch", train: str = "train_mae",
               val: str = "val_mae", train_elo: str | None = None,
               val_elo: str | None = None) -> DataFrame:
    """The training-log line per epoch; the Elo part only when Elo columns are given."""
    line = F.format_string(LOG_FORMAT, F.col(epoch), F.col(train), F.col(val))
    if train_elo and val_elo:
        line = F.concat(line, F.format_string(LOG_ELO_SUFFIX, F.col(train_elo), F.col(val_elo)))
    return history.withColumn("value", line)


def write_log(history: DataFrame, path: str, partition_by: str | None = "run", **kw) -> None:
    """Append log lines as text, a folder per run: rows of a run are brought to one
    task (a per-run log is small: one line per epoch) and written in epoch order.
    For many runs, ``append_log`` keeps one table."""
    df = format_log(history, **kw)
    epoch = kw.get("epoch", "epoch")
    if partition_by:
        df = df.repartition(partition_by).sortWithinPartitions(partition_by, epoch)
        df.select("value", partition_by).write.mode("append").partitionBy(partition_by).text(path)
    else:
        df.orderBy(epoch).select("value").write.mode("append").text(path)


def append_log(history: DataFrame, path: str, run: str = "run", **kw) -> int:
    """Append log lines of any number of runs to one Parquet table (run, epoch, value).  A line is written once, by run
    and epoch: epochs that are there already add nothing.  Returns how many were added."""
    epoch = kw.get("epoch", "epoch")
    return append_once(format_log(history, **kw).select(run, epoch, "value"), path, [run, epoch])

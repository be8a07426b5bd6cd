"""Run metadata and dataset sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fianchetto.sinks.writers import committed

# "Epoch   0 | Train MAE: 0.081552 | Val MAE: 0.081105" [+ " | Train MAE (Elo): .. | Val MAE (Elo): .."]
LOG_LINE = (r"^Epoch\s+(\d+) \| Train MAE: ([-0-9.eE+naif]+) \| Val MAE: ([-0-9.eE+naif]+)"
            r"(?: \| Train MAE \(Elo\): ([-0-9.eE+naif]+) \| Val MAE \(Elo\): ([-0-9.eE+naif]+))?")


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The split table written by ``write_splits``; ``split`` prunes partitions."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no dataset splits at {path}; run write_splits first") from e
        raise
    return df.where(F.col("split") == split) if split else df


def read_run_configs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Run configurations, one JSON object per file (``multi_line``) or JSON lines.

    ``run_id``/``run_time`` are those in the file, else they come from a
    ``config_YYYYmmdd_HHMMSS.json`` file name.  Of a folder that ``write_run_config``
    filled, what its manifest lists is read."""
    df = (spark.read.option("multiLine", multi_line).option("recursiveFileLookup", True)
          .json(committed(spark, path) or path).withColumn("source_file", F.col("_metadata.file_path")))
    stamp = F.regexp_extract("source_file", r"config_(\d{8}_\d{6})\.json$", 1)
    own_id = F.col("run_id").cast("string") if "run_id" in df.columns else F.lit(None).cast("string")
    own_time = F.col("run_time").cast("timestamp") if "run_time" in df.columns else F.lit(None).cast("timestamp")
    df = df.withColumn("run_id", F.coalesce(own_id, F.when(stamp != "", stamp)))
    stamped = F.try_to_timestamp(F.col("run_id"), F.lit("yyyyMMdd_HHmmss"))
    return df.withColumn("run_time", F.coalesce(own_time, stamped))


def parse_log_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Training-log text -> (epoch, train_mae, val_mae, train_mae_elo, val_mae_elo);
    lines that are not epoch lines are dropped; the Elo part is optional."""
    x = F.col(line_col)

    def g(i):
        return F.regexp_extract(x, LOG_LINE, i)

    out = lines.where(x.rlike(LOG_LINE)).select(
        *[c for c in lines.columns if c != line_col],
        g(1).cast("int").alias("epoch"), g(2).cast("double").alias("train_mae"),
        g(3).cast("double").alias("val_mae"),
        F.when(g(4) != "", g(4).cast("double")).alias("train_mae_elo"),
        F.when(g(5) != "", g(5).cast("double")).alias("val_mae_elo"))
    return out


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Read log text files (partition folders such as ``run=...`` become columns)."""
    return parse_log_lines(spark.read.text(path))


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    """Read the one-table log of ``append_log``: the lines that its manifest lists."""
    return parse_log_lines(spark.read.parquet(*(committed(spark, path) or [path])).select("run", "value"))

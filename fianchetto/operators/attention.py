"""Attention analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_positions(attention: DataFrame, weights: str = "weights", k: int = 10) -> DataFrame:
    """Mean attention per sequence position over all rows, top ``k`` by score
    (ties by position).  ``posexplode`` + a partial aggregate: the shuffle holds
    one row per position per task, whatever the number of games."""
    per_pos = (attention.select(F.posexplode(weights).alias("position", "w"))
               .groupBy("position").agg(F.avg(F.col("w").cast("double")).alias("score")))
    return per_pos.orderBy(F.desc("score"), F.asc("position")).limit(k) \
        .withColumn("position", F.col("position").cast("int"))

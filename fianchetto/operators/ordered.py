"""Order-dependent building blocks that stay parallel under skew.

A running aggregate over one huge partition (one big file, one hot run) must not
be computed by a single window task.  ``running_agg`` does it in two phases:
per-chunk totals (a small table), an exclusive prefix over chunks, then a window
inside each chunk, so no task sees more than one chunk of rows.

``exact_rank`` gives a dense 0-based rank by a hash key in the same way, with
buckets taken from a hash prefix: per-bucket counts -> offsets (a table of at
most ``16**prefix_len`` rows per partition value, so its size is bounded) ->
``row_number`` inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def materialize_df(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder (reliable
    checkpoint: survives executor loss, cuts the lineage)."""
    from fianchetto.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def running_agg(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str],
                chunk: Column, values: dict[str, Column], kind: str = "sum",
                inclusive: bool = True, materialize: bool = False) -> DataFrame:
    """Add one running ``kind`` column per entry of ``values``.

    ``chunk`` must be non-decreasing in ``order_by`` within a partition (e.g. the
    line number divided by a block size, or the input-split index).  Partition keys
    must not be NULL.  Exclusive sums start at 0; exclusive min/max start at NULL.

    The input is read twice (chunk totals, then rows).  With ``materialize`` it is
    first checkpointed to the shared checkpoint folder, so an expensive input (a
    decompressing scan, an unsaved parse) is computed once.
    """
    agg = _AGG[kind]
    names = list(values)
    tmp = df.withColumn("_chunk", chunk)
    for i, n in enumerate(names):
        tmp = tmp.withColumn(f"_v{i}", values[n])
    if materialize:
        tmp = materialize_df(tmp)
    per_chunk = tmp.groupBy(*partition_by, "_chunk").agg(
        *[agg(f"_v{i}").alias(f"_c{i}") for i in range(len(names))])
    w_chunks = (Window.partitionBy(*partition_by).orderBy("_chunk")
                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_chunk.select(*partition_by, "_chunk",
                               *[agg(f"_c{i}").over(w_chunks).alias(f"_o{i}")
                                 for i in range(len(names))])
    joined = tmp.join(offsets, [*partition_by, "_chunk"])
    w_in = (Window.partitionBy(*partition_by, "_chunk").orderBy(*order_by)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    for i, n in enumerate(names):
        inner = agg(f"_v{i}").over(w_in)
        if kind == "sum":
            val = F.coalesce(F.col(f"_o{i}"), F.lit(0)) + F.coalesce(inner, F.lit(0))
        elif kind == "min":
            val = F.least(F.col(f"_o{i}"), inner)
        else:
            val = F.greatest(F.col(f"_o{i}"), inner)
        joined = joined.withColumn(n, val)
    drop = ["_chunk"] + [f"_v{i}" for i in range(len(names))] + [f"_o{i}" for i in range(len(names))]
    return joined.drop(*drop)


def exact_rank(df: DataFrame, partition_by: Sequence[str], hash_col: str,
               tiebreak: Sequence[str], out: str = "rk", total: str | None = None,
               prefix_len: int = 4, materialize: bool = False) -> DataFrame:
    """0-based rank of each row inside ``partition_by`` by (``hash_col``, ``tiebreak``).

    ``hash_col`` must be a uniformly distributed lowercase hex string (e.g. md5)
    of a per-row id.  Ids must be distinct: rows sharing one id share a bucket
    (framing gives positional ids, so copies of a game still spread evenly).
    The offsets table has at most values * 16**prefix_len rows; how it is joined is
    left to adaptive execution, which knows its measured size.
    ``total`` optionally adds the partition's row count.  As in ``running_agg``
    the input is read twice unless ``materialize``.
    """
    b = F.substring(F.col(hash_col), 1, prefix_len)
    tmp = df.withColumn("_bucket", b)
    if materialize:
        tmp = materialize_df(tmp)
    counts = tmp.groupBy(*partition_by, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*partition_by).orderBy("_bucket")
         .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*partition_by, "_bucket",
                            F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy(*partition_by)).alias("_tot"))
    joined = tmp.join(offsets, [*partition_by, "_bucket"])
    w_in = Window.partitionBy(*partition_by, "_bucket").orderBy(F.col(hash_col), *tiebreak)
    res = joined.withColumn(out, F.col("_off") + F.row_number().over(w_in) - 1)
    if total:
        res = res.withColumn(total, F.col("_tot"))
    return res.drop("_bucket", "_off", "_tot")

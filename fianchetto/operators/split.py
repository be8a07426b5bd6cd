"""Dataset construction (L2-L5, A1): exact, reproducible splits and samples.

The original shuffles a Python list with a seed.  Here the order is the md5 of
``"<seed>:<id>"``: deterministic, independent of partitioning, and ranked with
``exact_rank`` (hash-prefix buckets) instead of one global sort window.
Sizes are exactly ``int(n*train)``, ``int(n*val)`` and the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fianchetto.constants import BATCH_SIZE, SPLIT_SEED, SPLIT_TRAIN, SPLIT_VAL
from fianchetto.operators.ordered import exact_rank


def seeded_hash(id_col: str, *salt) -> "F.Column":
    prefix = ":".join(str(s) for s in salt) + ":"
    return F.md5(F.concat(F.lit(prefix), F.col(id_col).cast("string")).cast("binary"))


def split_exact(games: DataFrame, id_col: str = "game_id", train_ratio: float = SPLIT_TRAIN,
                val_ratio: float = SPLIT_VAL, seed: int = SPLIT_SEED,
                materialize: bool = False) -> DataFrame:
    """Add ``split`` ('train'|'val'|'test'), global rank ``rk`` and ``split_rk``.

    The ranking reads ``games`` twice; read it from Parquet (``write_games``) or
    pass ``materialize=True`` when it is an expensive unsaved plan."""
    ranked = exact_rank(games.withColumn("_h", seeded_hash(id_col, seed)), [], "_h", [id_col],
                        out="rk", total="_n", materialize=materialize)
    train_end = (F.col("_n") * F.lit(float(train_ratio))).cast("long")
    val_end = train_end + (F.col("_n") * F.lit(float(val_ratio))).cast("long")
    rk = F.col("rk")
    return (ranked.withColumn("split", F.when(rk < train_end, "train")
                              .when(rk < val_end, "val").otherwise("test"))
            .withColumn("split_rk", F.when(rk < train_end, rk)
                        .when(rk < val_end, rk - train_end).otherwise(rk - val_end))
            .drop("_h", "_n"))


def split_counts(split_df: DataFrame) -> DataFrame:
    """Rows per split and the actual share (window over the 3-row result only)."""
    c = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n_games"))
    return c.withColumn("share", F.col("n_games") / F.sum("n_games").over(Window.partitionBy()))


def head_subset(split_df: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """First N rows of each split (in split order); a split not named keeps none."""
    cond = F.lit(False)
    for s, n in sizes.items():
        cond = cond | ((F.col("split") == s) & (F.col("split_rk") < n))
    return split_df.where(cond)


def sample_exact(split_df: DataFrame, sizes: dict[str, int], id_col: str = "game_id",
                 seed: int = SPLIT_SEED) -> DataFrame:
    """Exactly ``min(k, n)`` rows per split, without replacement, reproducible."""
    h = split_df.withColumn("_h2", seeded_hash(id_col, "sample", seed))
    ranked = exact_rank(h, ["split"], "_h2", [id_col], out="sample_rk")
    cond = F.lit(False)
    for s, n in sizes.items():
        cond = cond | ((F.col("split") == s) & (F.col("sample_rk") < n))
    return ranked.where(cond).drop("_h2")


def assign_batches(split_df: DataFrame, epochs=(0,), batch_size: int = BATCH_SIZE,
                   id_col: str = "game_id", seed: int = SPLIT_SEED,
                   shuffle_splits=("train",)) -> DataFrame:
    """One row (id, split, split_rk, epoch, batch_id, batch_pos) per game and epoch.

    Shuffled splits get a fresh order per epoch; the others keep split order.
    The last batch may be short.
    """
    # ids, splits and ranks only: a caller's other columns do not go through the shuffles
    narrow = split_df.select(id_col, "split", "split_rk")
    ep = narrow.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    ep = ep.withColumn("_h3", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"),
                                                F.col(id_col).cast("string")).cast("binary")))
    shuffled = ep.where(F.col("split").isin(*shuffle_splits))
    ordered = ep.where(~F.col("split").isin(*shuffle_splits)).withColumn("_ord", F.col("split_rk"))
    shuffled = exact_rank(shuffled, ["split", "epoch"], "_h3", [id_col], out="_ord")
    both = ordered.unionByName(shuffled)
    return (both.withColumn("batch_id", (F.col("_ord") / F.lit(batch_size)).cast("long"))
            .withColumn("batch_pos", (F.col("_ord") % F.lit(batch_size)).cast("int"))
            .drop("_h3", "_ord"))

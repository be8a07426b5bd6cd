"""Regression evaluation (A2-A6, A8-A12, P15): one-pass aggregates over a
``scored(game_id, target, pred)`` table of normalised values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fianchetto.constants import (DEFAULT_ELO_BANDS, DIFFICULTY_COLORS, DIFFICULTY_EXTRA_COLOR,
                                  DIFFICULTY_LABELS, ELO_MAX, ELO_MIN)
from fianchetto.functions.elo import denormalize_elo, to_float32
from fianchetto.operators.ordered import running_agg


def with_elo(scored: DataFrame, target: str = "target", pred: str = "pred",
             min_elo: int = ELO_MIN, max_elo: int = ELO_MAX,
             precision: str = "float64") -> DataFrame:
    """Add truncated ``target_elo`` / ``pred_elo``; ``precision='float32'`` first
    rounds both through FLOAT, as float32 tensors do."""
    t, p = F.col(target), F.col(pred)
    if precision == "float32":
        t, p = to_float32(t), to_float32(p)
    return (scored.withColumn("target_elo", denormalize_elo(t, min_elo, max_elo))
            .withColumn("pred_elo", denormalize_elo(p, min_elo, max_elo)))


def regression_metrics(scored: DataFrame, target: str = "target", pred: str = "pred",
                       with_r2: bool = False, elo: bool = True, group_by: Sequence[str] = (),
                       min_elo: int = ELO_MIN, max_elo: int = ELO_MAX,
                       precision: str = "float64") -> DataFrame:
    """mse, mae, rmse (normalised); optional r2; optional mae_elo, rmse_elo on
    truncated ratings.  One hash aggregate (partial + final), no sort."""
    df = with_elo(scored, target, pred, min_elo, max_elo, precision) if elo else scored
    t, p = F.col(target).cast("double"), F.col(pred).cast("double")
    if precision == "float32":
        t, p = to_float32(t), to_float32(p)
    err = t - p
    aggs = [F.count(F.lit(1)).alias("n"),
            F.avg(err * err).alias("mse"),
            F.avg(F.abs(err)).alias("mae"),
            F.sum(err * err).alias("_sse"),
            F.var_pop(t).alias("_vt")]
    if elo:
        d = (F.col("target_elo") - F.col("pred_elo")).cast("double")
        aggs += [F.avg(F.abs(d)).alias("mae_elo"), F.avg(d * d).alias("_mse_elo")]
    out = df.groupBy(*group_by).agg(*aggs).withColumn("rmse", F.sqrt("mse"))
    if with_r2:
        sst = F.col("_vt") * F.col("n")
        out = out.withColumn("r2", F.when(F.col("n") < 2, F.lit(float("nan")))
                             .when(sst == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
                             .otherwise(1.0 - F.col("_sse") / sst))
    if elo:
        out = out.withColumn("rmse_elo", F.sqrt("_mse_elo")).drop("_mse_elo")
    return out.drop("_sse", "_vt")


def evaluate_predictions(scored: DataFrame, **kw) -> DataFrame:
    """mse, mae, rmse, r2 (+ Elo errors)."""
    return regression_metrics(scored, with_r2=True, **kw)


def bands_frame(spark: SparkSession, bands=DEFAULT_ELO_BANDS) -> DataFrame:
    """(label, min_elo, max_elo) rows; a repeated label keeps its last range."""
    last = {}
    for label, lo, hi in bands:
        last.pop(label, None)
        last[label] = (int(lo), int(hi))
    rows = [(k, v[0], v[1]) for k, v in last.items()]
    return spark.createDataFrame(rows, "label string, min_elo int, max_elo int")


def segment_by_elo(scored: DataFrame, bands: DataFrame | None = None, target: str = "target",
                   pred: str = "pred", close_last: bool = False,
                   min_elo: int = ELO_MIN, max_elo: int = ELO_MAX,
                   precision: str = "float64") -> DataFrame:
    """Per band of *target* rating: count, mae, rmse (in rating points).

    Bands are half-open [min, max), may overlap (a row counts in each), and an
    empty band yields no row.  ``precision='float32'`` rounds targets and
    predictions through FLOAT before they are truncated to ratings.
    """
    spark = scored.sparkSession
    b = bands if bands is not None else bands_frame(spark)
    df = with_elo(scored, target, pred, min_elo, max_elo, precision)
    top = F.col("max_elo")
    if close_last:
        last = b.agg(F.max("max_elo")).scalar()
        top = F.when(F.col("max_elo") == last, F.col("max_elo") + 1).otherwise(F.col("max_elo"))
    joined = _band_join(df, "target_elo", b, top)
    d = (F.col("target_elo") - F.col("pred_elo")).cast("double")
    return (joined.groupBy("label", "min_elo", "max_elo")
            .agg(F.count(F.lit(1)).alias("count"), F.avg(F.abs(d)).alias("mae"),
                 F.sqrt(F.avg(d * d)).alias("rmse"))
            .withColumn("range", F.concat_ws("-", F.col("min_elo").cast("string"),
                                             F.col("max_elo").cast("string"))))


#: Bands up to which a band table is broadcast; a longer one is joined by rating.
BROADCAST_BANDS = 1000


def _band_join(df: DataFrame, elo: str, bands: DataFrame, top) -> DataFrame:
    """Rows joined with the bands [min_elo, top) that hold their whole-number rating.

    A checked, short band list is broadcast for a range join; a longer one becomes
    one row per rating of each band, joined by equality."""
    b = bands.withColumn("_top", top)
    if b.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS:
        e = F.col(elo)
        return df.join(F.broadcast(b), (e >= F.col("min_elo")) & (e < F.col("_top"))).drop("_top")
    each = b.where(F.col("min_elo") < F.col("_top")).withColumn("_elo", F.explode(F.sequence(F.col("min_elo"), F.col("_top") - 1)))
    return df.join(each, F.col(elo) == F.col("_elo")).drop("_top", "_elo")


def difficulty_segments(spark: SparkSession, num_segments: int = 4, min_elo: int = ELO_MIN,
                        max_elo: int = ELO_MAX) -> DataFrame:
    """Equal-width difficulty bands; bounds truncated to int like the original."""
    if num_segments <= 0:
        raise ZeroDivisionError("num_segments must be positive")
    size = (max_elo - min_elo) / num_segments
    i = F.col("id")
    labels = F.array(*[F.lit(x) for x in DIFFICULTY_LABELS])
    colors = F.array(*[F.lit(x) for x in DIFFICULTY_COLORS])
    lo = (F.lit(float(min_elo)) + i.cast("double") * F.lit(size)).cast("int")
    hi = (F.lit(float(min_elo)) + (i + 1).cast("double") * F.lit(size)).cast("int")
    return (spark.range(num_segments)
            .select(i.cast("int").alias("segment"),
                    F.coalesce(F.get(labels, i.cast("int")),
                               F.concat(F.lit("Level_"), (i + 1).cast("string"))).alias("difficulty"),
                    lo.alias("min_elo"), hi.alias("max_elo"),
                    F.coalesce(F.get(colors, i.cast("int")), F.lit(DIFFICULTY_EXTRA_COLOR)).alias("color"))
            .withColumn("elo_range", F.concat_ws("-", F.col("min_elo").cast("string"),
                                                 F.col("max_elo").cast("string"))))


def assign_difficulty(games: DataFrame, elo_col: str, segments: DataFrame) -> DataFrame:
    """Count games per difficulty band of ``elo_col`` ([min, max)); ratings outside
    all bands are in no row."""
    j = _band_join(games, elo_col, segments, F.col("max_elo"))
    return j.groupBy("segment", "difficulty", "elo_range", "min_elo", "max_elo", "color") \
        .agg(F.count(F.lit(1)).alias("n_games"))


def residuals(scored: DataFrame, target: str = "target", pred: str = "pred",
              elo: bool = True, precision: str = "float64") -> DataFrame:
    """target - prediction, in rating points when ``elo`` (else normalised);
    ``precision`` as in ``with_elo``."""
    if elo:
        df = with_elo(scored, target, pred, precision=precision)
        return df.withColumn("residual", F.col("target_elo") - F.col("pred_elo"))
    return scored.withColumn("residual", F.col(target) - F.col(pred))


def residual_histogram(res: DataFrame, col: str = "residual", bins: int = 50) -> DataFrame:
    """``bins`` equal-width bins over [min, max], last bin closed, empty bins kept.

    min/max come from one scalar subquery (a single aggregate pass, no global
    window, no collect); it is attached once as a column and read from there."""
    v = F.col(col).cast("double")
    stats = res.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()

    def with_bounds(df):
        # equal bounds are widened by 0.5 each side, like numpy
        b = df.withColumn("_s", stats)
        lo0, hi0 = F.col("_s.lo"), F.col("_s.hi")
        return (b.withColumn("_lo", F.when(lo0 == hi0, lo0 - 0.5).otherwise(lo0))
                .withColumn("_hi", F.when(lo0 == hi0, hi0 + 0.5).otherwise(hi0)).drop("_s"))

    lo, hi = F.col("_lo"), F.col("_hi")
    binned = with_bounds(res.where(F.col(col).isNotNull()).select(v.alias("_v")))
    b = F.least(F.floor((F.col("_v") - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1)).cast("int")
    counts = binned.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = res.sparkSession
    all_bins = with_bounds(spark.range(bins).select(F.col("id").cast("int").alias("bin")))
    out = all_bins.join(F.broadcast(counts), "bin", "left")
    width = (hi - lo) / F.lit(float(bins))
    return out.select("bin", (lo + F.col("bin") * width).alias("bin_lo"),
                      F.when(F.col("bin") == bins - 1, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def prediction_scatter(scored: DataFrame, bin_width: int = 100, target: str = "target",
                       pred: str = "pred", precision: str = "float64") -> DataFrame:
    """2-D binned (target, prediction) counts in rating points, with per-cell
    extremes; the diagonal's ends are the min/max over cells."""
    df = with_elo(scored, target, pred, precision=precision)
    tb = (F.floor(F.col("target_elo") / bin_width) * bin_width).cast("int")
    pb = (F.floor(F.col("pred_elo") / bin_width) * bin_width).cast("int")
    return df.groupBy(tb.alias("target_bin"), pb.alias("pred_bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("target_elo").alias("target_min"), F.max("target_elo").alias("target_max"),
        F.min("pred_elo").alias("pred_min"), F.max("pred_elo").alias("pred_max"))


def weighted_mean(df: DataFrame, value: str, weight: str, group_by: Sequence[str] = (),
                  order_by: Sequence[str] = ()) -> DataFrame:
    """sum(v*n)/sum(n) per group, plus the sum, the count and (given an order)
    the last value -- the fields of a running average meter."""
    v, n = F.col(value), F.col(weight)
    aggs = [(F.sum(v * n) / F.sum(n)).alias("mean"), F.sum(v * n).alias("total"),
            F.sum(n).alias("weight")]
    if order_by:
        aggs.append(F.max_by(v, F.struct(*order_by)).alias("last_val"))
    return df.groupBy(*group_by).agg(*aggs)


def running_weighted_mean(df: DataFrame, value: str, weight: str, partition_by: Sequence[str],
                          order_by: Sequence[str], chunk) -> DataFrame:
    """Running ``sum(v*n)/sum(n)`` in order, computed two-phase (see ``running_agg``)
    so a hot partition is split into chunks."""
    r = running_agg(df, partition_by, order_by, chunk,
                    {"run_sum": F.col(value) * F.col(weight), "run_count": F.col(weight)})
    return r.withColumn("run_avg", F.col("run_sum") / F.col("run_count"))


def train_epoch_metrics(batch_log: DataFrame, group_by=("run", "epoch"), loss: str = "loss",
                        mae: str = "mae", n: str = "n") -> DataFrame:
    """Epoch loss/mae as sample-weighted means of per-batch values."""
    w = F.col(n)
    return batch_log.groupBy(*group_by).agg(
        (F.sum(F.col(loss) * w) / F.sum(w)).alias("loss"),
        (F.sum(F.col(mae) * w) / F.sum(w)).alias("mae"),
        F.sum(w).alias("n_samples"), F.count(F.lit(1)).alias("n_batches"))


def validate(scored: DataFrame, batch_col: str = "batch_id", target: str = "target",
             pred: str = "pred", **kw) -> DataFrame:
    """Validation/test metrics: A2 over all rows plus ``loss``, the sample-weighted
    mean of per-batch MSE (the meter the training loop keeps).  Weighted by the
    batches' sizes, that mean is the MSE over all rows whatever the batches are, so
    one pass (and one run of the model that ``scored`` holds) gives both."""
    return regression_metrics(scored, target, pred, **kw).withColumn("loss", F.col("mse"))

"""Combining algorithms: surfaces, weights, ensemble mean and uncertainty, shares of the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import clean_number, finite
from .common import attach, key_list, lookup
from .evaluate import evaluate

# Weighting methods, fallback threshold, SD that counts as disagreement.
METHODS = ("mean", "weighted_auc", "weighted_tss")
DEFAULT_THRESHOLD = 0.5
DISAGREEMENT_SD = 0.20


def mean_surface(surfaces: DataFrame, keys=()) -> DataFrame:
    """Per cell and algorithm the mean over replicates that have a value."""
    return surfaces.groupBy(*key_list(keys), "algorithm", "row", "col").agg(
        F.avg(clean_number("value")).alias("value"))


def ensemble_weights(summary: DataFrame, method: str = "weighted_tss", keys=()) -> DataFrame:
    """Weights that sum to one; non-positive skill weighs nothing, equal if none is positive."""
    if method not in METHODS:
        raise ValueError(f"unknown ensemble method {method!r}")
    keys = key_list(keys)
    if method == "mean":
        raw = F.lit(1.0)
    else:
        metric = f"{method.removeprefix('weighted_')}_mean"
        if metric not in summary.columns:
            raise ValueError(f"{method} needs the column {metric}")
        raw = F.greatest(F.coalesce(clean_number(metric), F.lit(0.0)), F.lit(0.0))
    rows = summary.select(*keys, "algorithm", raw.alias("_raw"))
    every = rows.groupBy(*keys).agg(F.sum("_raw").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    weight = F.when(F.col("_sum") > 0, F.col("_raw") / F.col("_sum")).otherwise(1.0 / F.col("_n"))
    return attach(rows, every, keys).select(*keys, "algorithm", weight.alias("weight"))


def _weighted(values: DataFrame, weights: DataFrame, keys) -> DataFrame:
    """Attach each algorithm's weight; the weight table has one row per key and algorithm."""
    return lookup(values, weights, [*keys, "algorithm"])


def ensemble_surface(surfaces: DataFrame, weights: DataFrame, keys=()) -> DataFrame:
    """I4: weighted mean over algorithms with a value, and their unweighted population SD."""
    keys = key_list(keys)
    v = F.col("value")
    per = (_weighted(surfaces.withColumn("value", clean_number("value")), weights, keys)
           .groupBy(*keys, "row", "col")
           .agg(F.sum(v * F.col("weight")).alias("_wv"),
                F.sum(F.when(v.isNotNull(), F.col("weight"))).alias("_w"),
                F.count(v).alias("_n"), F.stddev_pop(v).alias("sd")))
    mean = F.col("_wv") / F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0)
    return per.select(*keys, "row", "col", F.when(F.col("_n") > 0, mean).alias("value"), "sd")


def ensemble_threshold(metrics: DataFrame, keys=()) -> DataFrame:
    """Mean over algorithms of their mean threshold; 0.5 when none has one."""
    keys = key_list(keys)
    per = metrics.groupBy(*keys, "algorithm").agg(F.avg(clean_number("threshold")).alias("t"))
    return per.groupBy(*keys).agg(F.coalesce(F.avg("t"), F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


def ensemble_scores(oof: DataFrame, weights: DataFrame, keys=()) -> DataFrame:
    """Held-out ensemble score per replicate and record, over the algorithms of that replicate.

    Weights are rescaled over the algorithms that ran in the replicate (equal if none weighs
    anything). A record one of them could not score has no ensemble score.
    """
    keys = key_list(keys)
    rep = [*keys, "replicate"]
    ran = oof.select(*rep, "algorithm").distinct().join(weights, [*keys, "algorithm"])
    ran = ran.withColumn("weight", F.greatest(F.col("weight"), F.lit(0.0)))
    total = ran.groupBy(*rep).agg(F.sum("weight").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_sum") > 0, F.col("weight") / F.col("_sum")).otherwise(1.0 / F.col("_n"))
    ran = ran.join(total, rep).select(*rep, "algorithm", share.alias("weight"), "_n")
    per = lookup(oof, ran, [*rep, "algorithm"]).groupBy(*rep, "pid").agg(
        F.max("label").alias("label"), F.sum(F.col("score") * F.col("weight")).alias("_s"),
        F.count(clean_number("score")).alias("_have"), F.max("_n").alias("_n"))
    # Twelve decimals make equal inputs tie whatever order they were added in.
    return per.select(*rep, "pid", "label", F.when(F.col("_have") == F.col("_n"), F.round("_s", 12)).alias("score"))


def ensemble_cv(oof: DataFrame, weights: DataFrame, keys=()) -> DataFrame:
    """Metrics of the ensemble per replicate from pooled held-out scores."""
    keys = key_list(keys)
    return evaluate(ensemble_scores(oof, weights, keys), "label", "score", [*keys, "replicate"])


def surface_shares(ensemble: DataFrame, threshold, keys=()) -> DataFrame:
    """Share of the map where algorithms disagree, and share at or above the threshold."""
    keys = key_list(keys)
    if isinstance(threshold, DataFrame):
        limit = threshold.select(*keys, F.col("threshold").alias("_t"))
        rows, t = (lookup(ensemble, limit, keys) if keys else attach(ensemble, limit, keys)), F.col("_t")
    else:
        rows, t = ensemble, F.lit(float(threshold))

    def share(of: str, test: Column) -> Column:
        return F.avg(F.when(finite(of), test.cast("int")))

    return rows.groupBy(*keys).agg(
        share("sd", F.col("sd") > DISAGREEMENT_SD).alias("disagreement_share"),
        share("value", F.col("value") >= t).alias("suitable_share"))


def curve_bands(curves: DataFrame, keys=()) -> DataFrame:
    """H9: mean and population SD of response curves over replicates, per grid point."""
    return curves.groupBy(*key_list(keys), "algorithm", "feature", "grid_i").agg(
        F.min_by("grid_v", "replicate").alias("grid_v"), F.avg("pred").alias("mean"),
        F.stddev_pop("pred").alias("sd"))


def importance_summary(importance: DataFrame, keys=()) -> DataFrame:
    """Mean and population SD per feature, a replicate without the feature counting as 0.

    The zeros enter through the counts alone, so they never have to be materialised.
    """
    keys = key_list(keys)
    by = [*keys, "algorithm"]
    replicates = importance.groupBy(*by).agg(F.count_distinct("replicate").alias("n_replicates"))
    per = importance.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("_c"), F.avg("importance").alias("_m"), F.var_pop("importance").alias("_v"))
    n, c, m = F.col("n_replicates"), F.col("_c"), F.col("_m")
    mean = c * m / n
    # Present values spread by _v around _m; absent ones sit at zero.
    var = (c * (F.col("_v") + (m - mean) ** 2) + (n - c) * mean ** 2) / n
    return per.join(replicates, by).select(*by, "feature", mean.alias("mean"), F.sqrt(var).alias("sd"), "n_replicates")


def _on_grid(curve: DataFrame, grid: DataFrame, by) -> DataFrame:
    """Each curve's value at the grid points of the first curve, straight between its own points."""
    nxt = W.partitionBy(*by, "algorithm").orderBy("grid_v")
    segments = curve.withColumns({"x1": F.lead("grid_v").over(nxt), "y1": F.lead("mean").over(nxt)})
    ends = curve.groupBy(*by, "algorithm").agg(
        F.min("grid_v").alias("lo"), F.max("grid_v").alias("hi"),
        F.min_by("mean", "grid_v").alias("at_lo"), F.max_by("mean", "grid_v").alias("at_hi"))
    asked = grid.join(ends, by)
    # One curve has a fixed, small number of points, so its segments are held as one array.
    held = segments.where("x1 is not null and x1 > grid_v").groupBy(*by, "algorithm").agg(
        F.collect_list(F.struct(F.col("grid_v").alias("x0"), F.col("mean").alias("y0"), "x1", "y1")).alias("_seg"))
    x = F.col("g")
    seg = F.filter("_seg", lambda s: (s.x0 <= x) & (x < s.x1))[0]
    inside = seg.y0 + (x - seg.x0) * (seg.y1 - seg.y0) / (seg.x1 - seg.x0)
    return asked.join(held, [*by, "algorithm"], "left").select(
        *by, "algorithm", "grid_i", F.col("g"),
        F.when(x <= F.col("lo"), F.col("at_lo")).when(x >= F.col("hi"), F.col("at_hi"))
        .otherwise(inside).alias("value"))


def ensemble_curves(bands: DataFrame, weights: DataFrame, order, keys=()) -> DataFrame:
    """Weighted mean of per-algorithm mean curves on the first algorithm's grid.

    ``order`` lists the algorithms; the first one present for a feature supplies the grid.
    """
    keys = key_list(keys)
    by = [*keys, "feature"]
    rank = F.array_position(F.array(*[F.lit(a) for a in order]), F.col("algorithm"))
    first = bands.groupBy(*by).agg(F.min_by("algorithm", rank).alias("algorithm"))
    grid = bands.join(first, [*by, "algorithm"]).select(*by, "grid_i", F.col("grid_v").alias("g"))
    values = _weighted(_on_grid(bands.select(*by, "algorithm", "grid_v", "mean"), grid, by), weights, keys)
    present = bands.select(*by, "algorithm").distinct().join(weights, [*keys, "algorithm"]).groupBy(*by).agg(
        F.sum(F.greatest("weight", F.lit(0.0))).alias("_w"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_w") > 0, F.greatest("weight", F.lit(0.0)) / F.col("_w")).otherwise(1.0 / F.col("_n"))
    return values.join(present, by).groupBy(*by, "grid_i").agg(
        F.min("g").alias("grid_v"), F.sum(F.col("value") * share).alias("pred"))

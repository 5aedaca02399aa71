"""Skill of scored records: AUC, best true-skill threshold, continuous Boyce index, summaries.

Scores are first reduced to distinct values with counts, so a score shared by a third of all
records is one row. Distinct scores are range-partitioned; each part is summed on its own and the
parts are combined from one small row each.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import clean_number
from .common import attach, checkpointed, join_on, key_list, range_parts

# Boyce windows and minimum sizes.
BOYCE_WINDOWS = 10
BOYCE_WIDTH = 0.1
BOYCE_MIN_PRESENCES = 5
BOYCE_MIN_SCORES = 20
BOYCE_MIN_WINDOWS = 4
METRICS = ("auc", "tss", "boyce", "threshold")
_EXACT = "decimal(38,0)"


def score_counts(df: DataFrame, label: str, score: str, keys=()) -> DataFrame:
    """Distinct scores ``s`` with their number of presences (``p``) and others (``n``).

    Unusable scores share a NULL row that counts nothing, so every key stays present.
    """
    keyed = df.select(*key_list(keys), clean_number(F.col(score).cast("double")).alias("s"),
                      (F.col(label) == 1).cast("int").alias("_y"))
    used = F.col("s").isNotNull()
    return keyed.groupBy(*key_list(keys), "s").agg(
        F.sum(F.when(used, F.col("_y")).otherwise(0)).alias("p"),
        F.sum(F.when(used, 1 - F.col("_y")).otherwise(0)).alias("n"))


def _gain(n: str, p: str):
    """n * all presences - p * all others, exact; whole-number arithmetic unless it could overflow."""
    small = F.col("all_p").cast("double") * F.col("all_n") < 4e18
    wide = "decimal(19,0)"
    exact = F.col(n).cast(wide) * F.col("all_p").cast(wide) - F.col(p).cast(wide) * F.col("all_n").cast(wide)
    return F.when(small, (F.col(n) * F.col("all_p") - F.col(p) * F.col("all_n")).cast(_EXACT)).otherwise(exact.cast(_EXACT))


def _ranking(counts: DataFrame, keys, with_tss: bool = True) -> DataFrame:
    """AUC (ties half), and maximum TSS with its threshold, per key."""
    parts = range_parts(counts, [*keys, "s"])
    if with_tss:
        parts = attach(parts, counts.groupBy(*keys).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")), keys)
    below = W.partitionBy(*keys, "_part").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    local = parts.withColumns({
        "pb": F.coalesce(F.sum("p").over(below), F.lit(0)), "nb": F.coalesce(F.sum("n").over(below), F.lit(0))})
    # Presences below the score are missed, others below it are correctly rejected. The gain
    # nb/N - pb/P is compared as an exact whole number, so equal gains really tie.
    sums = [F.sum(F.col("p") * (F.col("nb") + F.col("n") / 2.0)).alias("wins"), F.sum("p").alias("pp"), F.sum("n").alias("nn")]
    if with_tss:
        best = F.when(F.col("s").isNotNull(), F.struct(_gain("nb", "pb").alias("gain"), "s"))
        sums += [F.max(best).alias("best"), F.first("all_p").alias("all_p"), F.first("all_n").alias("all_n")]
    per_part = local.groupBy(*keys, "_part").agg(*sums)
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifted = per_part.withColumns({"p0": F.coalesce(F.sum("pp").over(earlier), F.lit(0)),
                                    "n0": F.coalesce(F.sum("nn").over(earlier), F.lit(0))})
    totals = [F.sum(F.col("wins") + F.col("pp") * F.col("n0").cast("double")).alias("wins"),
              F.sum("pp").alias("P"), F.sum("nn").alias("N")]
    if with_tss:
        moved = F.struct((F.col("best.gain") + _gain("n0", "p0")).cast(_EXACT).alias("gain"), F.col("best.s").alias("s"))
        totals.append(F.max(F.when(F.col("best").isNotNull(), moved)).alias("best"))
    out = shifted.groupBy(*keys).agg(*totals)
    both = (F.col("P") > 0) & (F.col("N") > 0)
    product = F.col("P").cast("double") * F.col("N")
    values = [F.when(both, F.col("wins") / product).alias("auc")]
    if with_tss:
        values += [F.when(both, F.col("best.gain").cast("double") / product).alias("tss"),
                   F.when(both, F.col("best.s")).alias("threshold")]
    return out.select(*keys, *values)


def _boyce(counts: DataFrame, keys, windows: int, width: float) -> DataFrame:
    """Spearman correlation of window centre and presence-to-expected ratio, per key."""
    span = counts.groupBy(*keys).agg(
        F.min("s").alias("lo"), F.max("s").alias("hi"),
        F.sum("p").alias("all_p"), F.sum(F.col("p") + F.col("n")).alias("all_t"))
    rows = attach(counts, span, keys)
    w = (F.col("hi") - F.col("lo")) * F.lit(float(width))
    first = F.col("lo") + w / 2.0
    step = ((F.col("hi") - w / 2.0) - first) / F.lit(float(windows - 1))
    aggs = []
    for i in range(windows):
        centre = first + step * float(i) if i < windows - 1 else F.col("hi") - w / 2.0
        inside = (F.col("s") >= centre - w / 2.0) & (F.col("s") <= centre + w / 2.0)
        aggs += [F.sum(F.when(inside, F.col("p"))).alias(f"p{i}"),
                 F.sum(F.when(inside, F.col("p") + F.col("n"))).alias(f"t{i}")]
    wide = rows.groupBy(*keys, "all_p", "all_t", "lo", "hi").agg(*aggs)
    per = wide.select(*keys, "all_p", "all_t", "lo", "hi", F.posexplode(F.array(
        *[F.struct(F.col(f"p{i}").alias("p"), F.col(f"t{i}").alias("t")) for i in range(windows)])).alias("i", "c"))
    usable = ((F.col("all_p") >= BOYCE_MIN_PRESENCES) & (F.col("all_t") >= BOYCE_MIN_SCORES)
              & (F.col("hi") > F.col("lo")) & (F.col("c.p") > 0) & (F.col("c.t") > 0))
    ratio = per.select(*keys, "i", F.when(
        usable, (F.col("c.p") / F.col("all_p")) / (F.col("c.t") / F.col("all_t"))).alias("pe"))
    same = W.partitionBy(*keys, "pe")
    rank = F.rank().over(W.partitionBy(*keys).orderBy("pe")) + (F.count(F.lit(1)).over(same) - 1) / 2.0
    ranked = ratio.withColumn("rank", F.when(F.col("pe").isNotNull(), rank))
    ranked = ranked.withColumn("i", F.when(F.col("pe").isNotNull(), F.col("i").cast("double")))
    # Written out because the built-in correlation fails on a constant side in ANSI mode.
    correlation = F.try_divide(F.covar_pop("i", "rank"), F.stddev_pop("i") * F.stddev_pop("rank"))
    return ranked.groupBy(*keys).agg(F.when(F.count("pe") >= BOYCE_MIN_WINDOWS, correlation).alias("boyce"))


def auc(df: DataFrame, label: str = "label", score: str = "score", keys=()) -> DataFrame:
    """H1: probability that a presence outscores another record; NULL with one class only."""
    keys = key_list(keys)
    return _ranking(score_counts(df, label, score, keys), keys, with_tss=False)


def max_tss(df: DataFrame, label: str = "label", score: str = "score", keys=()) -> DataFrame:
    """H2: largest sensitivity + specificity - 1 and the (highest) threshold reaching it."""
    keys = key_list(keys)
    return _ranking(score_counts(df, label, score, keys), keys).drop("auc")


def boyce(df: DataFrame, label: str = "label", score: str = "score", n_bins: int = BOYCE_WINDOWS,
          window_frac: float = BOYCE_WIDTH, keys=()) -> DataFrame:
    """H3: continuous Boyce index of presences against all records."""
    keys = key_list(keys)
    return _boyce(score_counts(df, label, score, keys), keys, n_bins, window_frac)


def evaluate(df: DataFrame, label: str = "label", score: str = "score", keys=()) -> DataFrame:
    """H4: auc, tss, boyce and threshold together; all NULL unless both classes are scored."""
    keys = key_list(keys)
    counts = checkpointed(score_counts(df, label, score, keys))  # read by five branches, made once
    ranking, index = _ranking(counts, keys), _boyce(counts, keys, BOYCE_WINDOWS, BOYCE_WIDTH)
    if keys:
        joined = join_on(ranking, index, keys, "left")
    else:
        joined = ranking.withColumn("boyce", index.select("boyce").scalar())
    joined = joined.withColumn("boyce", F.when(F.col("auc").isNotNull(), F.col("boyce")))
    return joined.select(*keys, *METRICS)


def summarise_metrics(metrics: DataFrame, keys=()) -> DataFrame:
    """H5: mean and population SD over replicates, missing values left out."""
    aggs = []
    if "error" in metrics.columns:
        metrics = metrics.where(F.col("error").isNull())
    for m in ("auc", "tss", "boyce"):
        aggs += [F.avg(clean_number(m)).alias(f"{m}_mean"), F.stddev_pop(clean_number(m)).alias(f"{m}_sd")]
    return metrics.groupBy(*key_list(keys), "algorithm").agg(
        *aggs, F.avg(clean_number("threshold")).alias("threshold_mean"), F.count(F.lit(1)).alias("n_replicates"))


def export_metrics(metrics: DataFrame, ensemble: DataFrame | None = None, keys=()) -> DataFrame:
    """H6: per-replicate metrics of every algorithm, then of the ensemble."""
    cols = [*key_list(keys), "algorithm", "replicate", *METRICS, "error"]

    def shaped(df):
        return df if "error" in df.columns else df.withColumn("error", F.lit(None).cast("string"))

    out = shaped(metrics).select(*cols)
    if ensemble is not None:
        out = out.unionByName(shaped(ensemble.withColumn("algorithm", F.lit("Ensemble"))).select(*cols))
    return out



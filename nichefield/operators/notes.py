"""Rule-based reading of finished runs, for any number of runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, key_list

# Headings, tones and the bounds between them.
HEADINGS = {
    "performance": "Overall performance", "mixed": "A mixed signal", "overfit": "Overfitting",
    "some_overfit": "Some overfitting", "general": "Generalization", "stability": "Run-to-run stability",
    "agreement": "Agreement between algorithms", "area": "Predicted suitable area",
    "extrapolation": "Extrapolation in the projection", "tested": "How performance was tested",
    "sample": "Sample size", "dropped": "Dropped predictors", "framing": "What the scores mean here",
    "cleaning": "Records removed in cleaning",
}
TSS_GOOD, TSS_OK, TSS_SPREAD = 0.6, 0.4, 0.2
AUC_OK, BOYCE_OK = 0.7, 0.5
GAP_HIGH, GAP_SOME, GAP_CLOSE, CV_SOUND = 0.15, 0.08, 0.05, 0.70
SD_HIGH, SD_LOW = 0.10, 0.05
DISAGREE_LOW, DISAGREE_HIGH = 10, 25
AREA_SMALL, AREA_LARGE = 10, 50
EXTRAPOLATION_HIGH = 20
SAMPLE_TINY, SAMPLE_SMALL, SAMPLE_MODEST = 25, 50, 100
REMOVED_SOME, REMOVED_MUCH = 0.10, 0.30
SCORES = ("auc_mean", "tss_mean", "boyce_mean", "auc_sd", "tss_sd", "boyce_sd")
STEADY = 12  # digits of a mean or SD that do not depend on the order of its sum


def headline(summary: DataFrame, keys=()) -> DataFrame:
    """Per run the row to report: the ensemble if there is one, else the best mean TSS, of equal ones the first by name.

    Means and SDs are taken to ``STEADY`` digits, so that the order in which a sum was taken picks no algorithm and moves no
    value over a bound of the rules."""
    keys = key_list(keys)
    summary = summary.withColumns({c: F.round(c, STEADY) for c in SCORES})
    single = F.col("algorithm") != "Ensemble"
    rank = F.struct(single.alias("s"), (-F.coalesce("tss_mean", F.lit(float("-inf")))).alias("t"), "algorithm")
    alone = F.when(single, F.col("tss_mean"))
    return (summary.groupBy(*keys)
            .agg(F.min_by(F.struct("algorithm", *SCORES), rank).alias("h"), F.min(alone).alias("tss_low"),
                 F.max(alone).alias("tss_high"), F.count(alone).alias("n_tss"))
            .select(*keys, "h.*", "tss_low", "tss_high", "n_tss"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _number(col: str, digits: int = 3) -> Column:
    return F.coalesce(F.round(F.col(col), digits).cast("string"), F.lit("n/a"))


def _percent(col: str) -> Column:
    return F.concat(F.round(F.col(col) * 100.0, 1).cast("string"), F.lit("%"))


def _note(when: Column, heading: str, tone, text: Column) -> Column:
    tone = tone if isinstance(tone, Column) else F.lit(tone)
    return F.when(when, F.struct(F.lit(HEADINGS[heading]).alias("heading"), tone.alias("tone"), text.alias("text")))


def _rules() -> list[Column]:
    tss, auc, boyce = F.col("tss_mean"), F.col("auc_mean"), F.col("boyce_mean")
    gap = F.col("train_auc") - F.col("cv_auc")
    both = F.col("train_auc").isNotNull() & F.col("cv_auc").isNotNull()
    versus = _text(" (AUC ", _number("train_auc"), " on training data, ", _number("cv_auc"), " held out).")
    level = F.when(tss >= TSS_GOOD, "good").when(tss >= TSS_OK, "ok").otherwise("caution")
    worst = F.greatest("auc_sd", "tss_sd", "boyce_sd")  # ignores missing ones
    moves = F.when(worst > SD_HIGH, "caution").when(worst <= SD_LOW, "good").otherwise("ok")
    differ = F.col("disagreement_share") * 100.0
    agree = F.when(differ < DISAGREE_LOW, "good").when(differ >= DISAGREE_HIGH, "caution").otherwise("info")
    area = F.col("suitable_share") * 100.0
    outside = F.col("extrapolated_share") * 100.0
    n = F.col("n_presence")
    spatial = F.col("split_method") == "spatial_block"
    size = F.when(n < SAMPLE_SMALL, "caution").when(n < SAMPLE_MODEST, "ok").otherwise("info")
    removed = F.col("removed")
    spread = F.when(F.col("n_tss") >= 2, _text(
        " TSS of single algorithms runs from ", _number("tss_low"), " to ", _number("tss_high"),
        F.when(F.col("tss_high") - F.col("tss_low") >= TSS_SPREAD, "; which algorithm is used matters.").otherwise(".")
    )).otherwise(F.lit(""))
    verdict = (F.when(tss >= TSS_GOOD, "separates suitable from unsuitable conditions clearly")
               .when(tss >= TSS_OK, "finds the broad pattern but not the detail")
               .otherwise("hardly tells occupied sites from the rest"))
    return [
        _note(F.lit(True), "performance", level, _text(
            F.col("algorithm"), " ", verdict, " (AUC ", _number("auc_mean"), ", TSS ", _number("tss_mean"),
            ", Boyce ", _number("boyce_mean"), ").", spread)),
        _note((auc >= AUC_OK) & (boyce < BOYCE_OK), "mixed", "caution", _text(
            "Sites are ranked well (AUC ", _number("auc_mean"), ") but suitability values are not proportional "
            "to occurrence (Boyce ", _number("boyce_mean"), "); prefer the binary map.")),
        _note(both & (gap >= GAP_HIGH), "overfit", "caution", _text("Training skill is far above held-out skill", versus)),
        _note(both & (gap >= GAP_SOME) & (gap < GAP_HIGH), "some_overfit", "info",
              _text("Training skill is somewhat above held-out skill", versus)),
        _note(both & (gap < GAP_CLOSE) & (F.col("cv_auc") >= CV_SOUND), "general", "good",
              _text("Training and held-out skill agree", versus)),
        _note(worst.isNotNull(), "stability", moves, _text(
            "Largest SD of a score over replicates: ", F.round(worst, 3).cast("string"), ".")),
        _note(differ.isNotNull(), "agreement", agree, _text(
            "Algorithms disagree over ", _percent("disagreement_share"), " of the map.")),
        _note(area.isNotNull(), "area", "info", _text(
            _percent("suitable_share"), " of the area is above the threshold: ",
            F.when(area < AREA_SMALL, "a small part").when(area > AREA_LARGE, "most of it").otherwise("a moderate part"), ".")),
        _note(outside.isNotNull(), "extrapolation", F.when(outside >= EXTRAPOLATION_HIGH, "caution").otherwise("info"),
              _text(_percent("extrapolated_share"), " of the projection lies beyond the training conditions.")),
        _note(F.col("split_method").isNotNull(), "tested", F.when(spatial, "good").otherwise("ok"), F.when(
            spatial, F.lit("Held-out spatial blocks test prediction into new ground.")).otherwise(_text(
                "Held out by ", F.replace(F.col("split_method"), F.lit("_"), F.lit(" ")),
                "; nearby records can flatter the scores."))),
        _note(n.isNotNull(), "sample", size, _text(
            n.cast("string"), " presences: ",
            F.when(n < SAMPLE_TINY, "too few for firm results").when(n < SAMPLE_SMALL, "a small sample")
            .when(n < SAMPLE_MODEST, "a modest sample").otherwise("a sound sample"),
            F.when(F.col("has_maxent"), "; MaxEnt features were limited to match.").otherwise("."))),
        _note(F.col("n_dropped") > 0, "dropped", "info", _text(
            F.col("n_dropped").cast("string"), " predictors were set aside as collinear.")),
        _note(F.col("presence_only"), "framing", "info", F.lit(
            "Scores compare presences with background, not with true absences.")),
        _note(removed >= REMOVED_SOME, "cleaning", F.when(removed >= REMOVED_MUCH, "caution").otherwise("info"),
              _text(_percent("removed"), " of the records were removed by cleaning and thinning.")),
    ]


def run_notes(summary: DataFrame, runs: DataFrame, keys=()) -> DataFrame:
    """L1: notes of every run as rows (keys, heading, tone, text).

    ``summary`` holds per-algorithm means and SDs of each run (with an ``Ensemble`` row if any),
    ``runs`` one row of facts per run (without keys: of the only run). All rules are tested in one pass over the joined row.
    """
    keys = key_list(keys)
    facts = attach(headline(summary, keys), runs, keys)
    notes = facts.select(*keys, F.explode(F.array_compact(F.array(*_rules()))).alias("n"))
    return notes.select(*keys, "n.heading", "n.tone", "n.text")

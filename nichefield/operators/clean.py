"""Occurrence cleaning and thinning. Every function takes optional ``keys`` such as a species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import all_finite, not_nan, with_cell
from ..grid import Grid
from .cells import extract
from .common import key_list

# The cleaning rules in the order they apply.
RULES = ("nan_coords", "duplicate", "zero_zero", "out_of_extent", "nodata_cell")


def _predictors(cells: DataFrame, keys) -> list[str]:
    return [c for c in cells.columns if c not in {"row", "col", "x", "y", *keys}]


def _judged(occ: DataFrame, cells: DataFrame, grid: Grid, keys, predictors=None) -> DataFrame:
    """One row per distinct coordinate: first record, number of copies, first rule it fails.

    Grouping by coordinate settles duplicates with a map-side combine, so a coordinate shared by
    a third of all records costs one partial row per task.
    """
    keys = key_list(keys)
    predictors = list(predictors or _predictors(cells, keys))
    xy = occ.withColumns({"x": not_nan("x"), "y": not_nan("y")})
    rest = [c for c in occ.columns if c not in {"rid", "x", "y", *keys}]
    firsts = xy.groupBy(*keys, "x", "y").agg(
        F.min("rid").alias("rid"), F.count(F.lit(1)).alias("_copies"),
        *[F.min_by(c, "rid").alias(c) for c in rest])
    inside = (F.col("x").between(grid.minx, grid.maxx) & F.col("y").between(grid.miny, grid.maxy))
    rule = (F.when(F.col("x").isNull() | F.col("y").isNull(), "nan_coords")
            .when((F.col("x") == 0) & (F.col("y") == 0), "zero_zero")
            .when(~inside, "out_of_extent"))
    located = with_cell(firsts.withColumn("_rule", rule), grid)
    seen = extract(located, cells, predictors)
    rule = F.coalesce(F.col("_rule"), F.when(~all_finite(predictors), F.lit("nodata_cell")))
    return seen.withColumn("drop_rule", rule).drop("_rule")


def clean_points(occ: DataFrame, cells: DataFrame, grid: Grid, keys=(), predictors=None,
                 with_values: bool = False) -> DataFrame:
    """Surviving records; ``with_values`` keeps their cell and predictor values."""
    keys = key_list(keys)
    predictors = list(predictors or _predictors(cells, keys))
    kept = _judged(occ, cells, grid, keys, predictors).where(F.col("drop_rule").isNull())
    return kept.select(*occ.columns, *(["row", "col", *predictors] if with_values else []))


def clean_report(occ: DataFrame, cells: DataFrame, grid: Grid, keys=(), predictors=None) -> DataFrame:
    """Records dropped per rule (only rules that dropped any) with input and output counts."""
    keys = key_list(keys)
    judged = _judged(occ, cells, grid, keys, predictors)
    failed = {r: F.count_if(F.col("drop_rule") == r) for r in ("zero_zero", "out_of_extent", "nodata_cell")}
    lost = F.col("drop_rule") == "nan_coords"
    counts = {"nan_coords": F.sum(F.when(lost, F.col("_copies")).otherwise(0)),
              "duplicate": F.sum(F.when(F.col("drop_rule").isNull() | ~lost, F.col("_copies") - 1).otherwise(0)),
              **failed}
    wide = judged.groupBy(*keys).agg(
        F.sum("_copies").alias("n_input"), F.count_if(F.col("drop_rule").isNull()).alias("n_output"),
        *[counts[r].cast("bigint").alias(r) for r in RULES])
    pairs = ", ".join(f"'{r}', {r}" for r in RULES)
    long = wide.select(*keys, F.expr(f"stack({len(RULES)}, {pairs}) as (rule, dropped)"),
                       "n_input", "n_output")
    return long.where(F.col("dropped") > 0)


def thin_points(occ: DataFrame, grid: Grid, keys=()) -> DataFrame:
    """The first record per cell and presence class."""
    keys = key_list(keys)
    rest = [c for c in occ.columns if c not in {"rid", "presence", "row", "col", *keys}]
    return (with_cell(occ, grid).groupBy(*keys, "row", "col", "presence")
            .agg(F.min("rid").alias("rid"), *[F.min_by(c, "rid").alias(c) for c in rest])
            .select(*occ.columns))


def thin_report(occ: DataFrame, grid: Grid, keys=()) -> DataFrame:
    """Records before and after thinning."""
    keys = key_list(keys)
    pixels = with_cell(occ, grid).groupBy(*keys, "row", "col", "presence").agg(F.count(F.lit(1)).alias("n"))
    return (pixels.groupBy(*keys)
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_input"), F.count(F.lit(1)).alias("n_output"))
            .withColumn("n_removed", F.col("n_input") - F.col("n_output")))


def removed_fraction(raw: DataFrame, final: DataFrame, keys=()) -> DataFrame:
    """Share of the raw records lost over all cleaning steps."""
    keys = key_list(keys)
    both = raw.select(*keys, F.lit(1).alias("_raw")).unionByName(
        final.select(*keys, F.lit(0).alias("_raw")))
    return (both.groupBy(*keys)
            .agg(F.count_if(F.col("_raw") == 1).alias("n_raw"), F.count_if(F.col("_raw") == 0).alias("n_final"))
            .withColumn("removed", 1 - F.try_divide("n_final", "n_raw")))

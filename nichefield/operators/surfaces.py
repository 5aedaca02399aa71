"""Scoring a cell table. Many models are scored side by side in one pass without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..models.base import Model
from .common import key_list


def predict_surface(model: Model, cells: DataFrame, keys=(), replicate: int = 0) -> DataFrame:
    """One model's value per cell; incomplete cells are NULL. Predictors go by name."""
    missing = [p for p in model.predictors if p not in cells.columns]
    if missing:
        raise ValueError(f"the cell table lacks predictors {missing}")
    keys = key_list(keys)
    return model.score(cells.select(*keys, "row", "col", *model.predictors), "value").select(
        *keys, F.lit(model.name).alias("algorithm"), F.lit(replicate).alias("replicate"), "row", "col", "value")


def _add(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _mean_present(columns: list[Column]) -> Column:
    have = _add([c.isNotNull().cast("int") for c in columns])
    return F.when(have > 0, _add([F.coalesce(c, F.lit(0.0)) for c in columns]) / have)


def predict_wide(models: dict[tuple[str, int], Model], cells: DataFrame, keys=()) -> DataFrame:
    """Per cell one column per algorithm: the mean over its replicate models.

    Every model reads the same row, so a grid of any size is scanned once and never shuffled.
    """
    keys = key_list(keys)
    predictors = list(dict.fromkeys(p for m in models.values() for p in m.predictors))
    scored, names = cells.select(*keys, "row", "col", *predictors), {}
    for (algorithm, replicate), model in models.items():
        out = f"{algorithm}__{replicate}"
        names.setdefault(algorithm, []).append(out)
        scored = model.score(scored, out)
    return scored.select(*keys, "row", "col",
                         *[_mean_present([F.col(c) for c in cols]).alias(a) for a, cols in names.items()])


def _binary(value: Column, threshold: float) -> Column:
    return F.when(value.isNull(), F.lit(255)).when(value >= threshold, F.lit(1)).otherwise(F.lit(0))


def ensemble_wide(surface: DataFrame, weights: dict[str, float], threshold: float | None = None,
                  keys=(), own_thresholds: dict[str, float] | None = None) -> DataFrame:
    """I4 on side-by-side columns: weighted mean and population SD as row arithmetic.

    I12: ``threshold`` adds the ensemble's binary surface, ``own_thresholds`` one per algorithm (``<name>_binary``).
    """
    names = [a for a in weights if a in surface.columns]
    columns = [F.col(a) for a in names]
    have = _add([c.isNotNull().cast("int") for c in columns])
    mass = _add([F.when(F.col(a).isNotNull(), F.lit(float(weights[a]))).otherwise(F.lit(0.0)) for a in names])
    total = _add([F.coalesce(F.col(a) * float(weights[a]), F.lit(0.0)) for a in names])
    centre = _mean_present(columns)
    spread = _add([F.coalesce((c - centre) * (c - centre), F.lit(0.0)) for c in columns]) / have
    value = F.when(have > 0, total / F.when(mass > 0, mass).otherwise(F.lit(1.0)))
    out = surface.select(*key_list(keys), "row", "col", *names, value.alias("value"),
                         F.when(have > 0, F.sqrt(spread)).alias("sd"))
    cuts = {f"{a}_binary": _binary(F.col(a), t) for a, t in (own_thresholds or {}).items() if a in names}
    if threshold is not None:
        cuts["binary"] = _binary(F.col("value"), threshold)
    return out.withColumns(cuts) if cuts else out

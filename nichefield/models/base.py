"""The contract every fitted model keeps, and the sums they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import all_finite, complete_rows, spread_or_one


@dataclass
class Model:
    """A fitted model. ``state`` is plain numbers and lists; ``stage`` an optional MLlib model."""

    name: str
    predictors: list[str]
    params: dict[str, Any]
    state: dict[str, Any] = field(default_factory=dict)
    stage: Any = None

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Add the suitability in [0, 1]; NULL where a predictor is missing."""
        from .registry import scorer

        return scorer(self.name)(self, df, out)


def by_formula(formula: Callable[[Model], Column]):
    """Scoring that is pure column arithmetic, so it fuses with the scan of the cell table."""
    def score(model: Model, df: DataFrame, out: str) -> DataFrame:
        p = formula(model)
        inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))
        return df.withColumn(out, F.when(all_finite(model.predictors), inside))
    return score


def in_batches(compute: Callable[[Model, pd.DataFrame], np.ndarray]):
    """Scoring by a function of the model and a frame of its predictors, called for whole Arrow batches in the tasks."""
    def score(model: Model, df: DataFrame, out: str) -> DataFrame:
        bare = Model(model.name, model.predictors, model.params, model.state)  # a stage does not travel to tasks

        @F.pandas_udf("double")
        def value(*columns: pd.Series) -> pd.Series:
            frame = pd.concat(columns, axis=1).set_axis(bare.predictors, axis=1)
            return pd.Series(np.clip(np.asarray(compute(bare, frame), float), 0.0, 1.0))

        given = [F.coalesce(F.col(p).cast("double"), F.lit(0.0)) for p in model.predictors]
        return df.withColumn(out, F.when(all_finite(model.predictors), value(*given)))
    return score


def training_rows(df: DataFrame, predictors, label: str) -> DataFrame:
    return complete_rows(df, predictors).select(
        *[F.col(p).cast("double").alias(p) for p in predictors], F.col(label).cast("int").alias("label"))


def summary_of(rows: DataFrame, predictors) -> dict:
    """Row counts, means and population SDs in one pass."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("n1"),
                 *[F.avg(p).alias(f"m_{i}") for i, p in enumerate(predictors)],
                 *[spread_or_one(F.stddev_pop(p)).alias(f"s_{i}") for i, p in enumerate(predictors)],
                 *[F.stddev_pop(p).alias(f"r_{i}") for i, p in enumerate(predictors)]).first()
    if not r.n or not r.n1 or r.n1 == r.n:
        raise ValueError("fitting needs complete records of both classes")
    each = range(len(predictors))
    return {"n": r.n, "n1": r.n1, "mean": [r[f"m_{i}"] for i in each], "sd": [r[f"s_{i}"] for i in each],
            "raw_sd": [r[f"r_{i}"] for i in each]}


def standard_columns(predictors, mean, sd) -> list[Column]:
    return [(F.col(p) - m) / s for p, m, s in zip(predictors, mean, sd)]


def weighted_sum(columns, weights, start: float = 0.0) -> Column:
    return reduce(lambda a, b: a + b, [c * float(w) for c, w in zip(columns, weights) if w != 0.0],
                  F.lit(float(start)))


def logistic(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))

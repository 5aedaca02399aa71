"""Logistic regression on standardised predictors and their squares."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from .base import Model, by_formula, logistic, standard_columns, summary_of, training_rows, weighted_sum

DEFAULTS = {"C": 1.0, "max_iter": 500}


def _terms(predictors, mean, sd):
    z = standard_columns(predictors, mean, sd)
    return z + [c * c for c in z]


def fit(df, predictors, label, seed, C, max_iter) -> Model:
    rows = training_rows(df, predictors, label)
    s = summary_of(rows, predictors)
    data = rows.select("label", array_to_vector(F.array(*_terms(predictors, s["mean"], s["sd"]))).alias("features"))
    lr = LogisticRegression(regParam=1.0 / (C * s["n"]), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, labelCol="label")
    m = lr.fit(data)
    return Model("lr", predictors, {"C": C, "max_iter": max_iter},
                 {"mean": s["mean"], "sd": s["sd"], "coef": m.coefficients.toArray().tolist(),
                  "intercept": float(m.intercept)})


def _probability(model: Model):
    st = model.state
    return logistic(weighted_sum(_terms(model.predictors, st["mean"], st["sd"]), st["coef"], st["intercept"]))


score = by_formula(_probability)

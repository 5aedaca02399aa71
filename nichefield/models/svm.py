"""Support vector machine with calibrated probabilities.

Spark's SVM is linear, so the kernel is approximated: kernel values against a fixed number of
hashed landmark rows, whitened by their own kernel matrix, are the features of a linear SVM.
Margins of rows left out of the fit are turned into probabilities by a logistic curve.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_uniform
from ..functions.scalars import all_finite
from .base import Model, standard_columns, summary_of, training_rows

DEFAULTS = {"C": 1.0, "gamma": "scale", "kernel": "rbf", "landmarks": 64, "folds": 3, "max_iter": 100}
KERNELS = ("rbf", "linear", "poly", "sigmoid")
POLY_DEGREE = 3  # fixed value
TOLERANCE = 1e-3  # the hinge loss has kinks; finer steps only circle around them


def _kernel(kind: str, gamma: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if kind == "rbf":
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.exp(-gamma * np.maximum(d2, 0))
    if kind == "poly":
        return (gamma * a @ b.T) ** POLY_DEGREE
    return np.tanh(gamma * a @ b.T)


def _features(kind, gamma, marks, whiten):
    """Arrow-batched map from standardised predictors to SVM features."""
    def to_features(cols) -> np.ndarray:
        z = np.column_stack([np.nan_to_num(c.to_numpy(float)) for c in cols])
        return z if kind == "linear" else _kernel(kind, gamma, z, np.asarray(marks)) @ np.asarray(whiten)
    return to_features


def fit(df, predictors, label, seed, C, gamma, kernel, landmarks, folds, max_iter) -> Model:
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {KERNELS}")
    rows = training_rows(df, predictors, label)
    s = summary_of(rows, predictors)
    p = len(predictors)
    if gamma == "scale":  # one over predictors times the variance of the standardised matrix
        varying = sum(r >= 1e-12 for r in s["raw_sd"])
        gamma_value = 1.0 / (p * (varying / p)) if varying else 1.0
    else:
        gamma_value = float(gamma)
    z = rows.select("label", *[c.alias(n) for n, c in zip(predictors, standard_columns(predictors, s["mean"], s["sd"]))])
    pick = hash_uniform(seed, *[F.col(n) for n in predictors], F.col("label"))
    state = {"mean": s["mean"], "sd": s["sd"], "gamma": gamma_value, "marks": None, "whiten": None}
    z = z.withColumn("_u", pick)
    if kernel != "linear":
        distinct = z.select(*predictors, "_u").dropDuplicates(predictors).orderBy("_u").limit(landmarks)
        marks = np.array([[r[n] for n in predictors] for r in distinct.collect()])
        values, vectors = np.linalg.eigh(_kernel(kernel, gamma_value, marks, marks))
        good = values > 1e-10 * max(values.max(), 1e-300)
        state["marks"] = marks.tolist()
        state["whiten"] = (vectors[:, good] / np.sqrt(values[good])).tolist()
    mapper = _features(kernel, gamma_value, state["marks"], state["whiten"])

    @F.pandas_udf("array<double>")
    def features(*cols: pd.Series) -> pd.Series:
        return pd.Series(list(mapper(cols)))

    data = z.select("label", array_to_vector(features(*predictors)).alias("features"),
                    F.floor(hash_uniform(seed, "fold", *[F.col(n) for n in predictors], F.col("label")) * folds).cast("int").alias("fold")).persist()
    try:
        svc = LinearSVC(labelCol="label", regParam=1.0 / (C * s["n"]), maxIter=max_iter, tol=TOLERANCE, standardization=False,
                        predictionCol="", rawPredictionCol="raw")
        def margins(train, test):
            m = svc.fit(train)
            return m.transform(test).select("label", vector_to_array("raw")[1].alias("m"))

        held = reduce(DataFrame.unionByName,
                      [margins(data.where(F.col("fold") != i), data.where(F.col("fold") == i)) for i in range(folds)])
        curve = LogisticRegression(labelCol="label", maxIter=100).fit(
            held.select("label", array_to_vector(F.array("m")).alias("features")))
        final = svc.fit(data)
    finally:
        data.unpersist()
    state.update(coef=final.coefficients.toArray().tolist(), intercept=float(final.intercept),
                 slope=float(curve.coefficients[0]), offset=float(curve.intercept))
    return Model("svm", predictors, {"C": C, "gamma": gamma, "kernel": kernel, "landmarks": landmarks,
                                     "folds": folds, "max_iter": max_iter}, state)


def score(model: Model, df, out: str):
    st = model.state
    mapper = _features(model.params["kernel"], st["gamma"], st["marks"], st["whiten"])
    coef, intercept, slope, offset = np.asarray(st["coef"]), st["intercept"], st["slope"], st["offset"]

    @F.pandas_udf("double")
    def probability(*cols: pd.Series) -> pd.Series:
        margin = mapper(cols) @ coef + intercept
        return pd.Series(1.0 / (1.0 + np.exp(-(slope * margin + offset))))

    z = standard_columns(model.predictors, st["mean"], st["sd"])
    return df.withColumn(out, F.when(all_finite(model.predictors), probability(*z)))

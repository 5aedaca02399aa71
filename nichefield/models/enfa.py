"""Ecological niche factor analysis: suitability falls with distance from the presences' centre."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from .base import Model, by_formula, standard_columns, summary_of, training_rows

DEFAULTS = {"ridge": 1e-6}
SCALE_QUANTILE = 0.95  # fixed value: share of presences within one unit of decay


def _distance(predictors, st):
    z = standard_columns(predictors, st["mean"], st["sd"])
    d = [c - float(m) for c, m in zip(z, st["centre"])]
    total = F.lit(0.0)
    for i, row in enumerate(st["precision"]):
        total = total + d[i] * d[i] * float(row[i])
        for j in range(i + 1, len(d)):
            total = total + d[i] * d[j] * float(row[j] + st["precision"][j][i])
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def fit(df, predictors, label, seed, ridge) -> Model:
    rows = training_rows(df, predictors, label)
    s, p = summary_of(rows, predictors), len(predictors)
    if s["n1"] < 2:
        raise ValueError("niche factor analysis needs at least 2 presences")
    z = standard_columns(predictors, s["mean"], s["sd"])
    presences = rows.where("label = 1")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    r = presences.agg(*[F.avg(c) for c in z], *[F.covar_samp(z[i], z[j]) for i, j in pairs]).first()
    cov = np.zeros((p, p))
    for (i, j), v in zip(pairs, r[p:]):
        cov[i, j] = cov[j, i] = v
    state = {"mean": s["mean"], "sd": s["sd"], "centre": list(r[:p]),
             "precision": np.linalg.pinv(cov + np.eye(p) * ridge).tolist()}
    spread = quantiles(presences.select(_distance(predictors, state).alias("d")), ["d"], [SCALE_QUANTILE])
    scale = spread.first().d[0]
    state["scale"] = float(scale) if scale > 0 else 1.0
    return Model("enfa", predictors, {"ridge": ridge}, state)


score = by_formula(lambda m: F.exp(-_distance(m.predictors, m.state) / m.state["scale"]))

"""Logistic additive model: one penalised cubic spline per predictor.

Fitting is iteratively reweighted least squares. Each iteration is one distributed sum of the
weighted cross-products of the spline columns; only that small matrix reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .base import Model, by_formula, logistic, training_rows

DEFAULTS = {"n_splines": 10, "penalty": 0.6, "max_iter": 100}
# Spline order, convergence tolerance, ridge that keeps the system solvable.
ORDER = 3
TOLERANCE = 1e-4
RIDGE = 1e-6


def _weights(u):
    """The four cubic spline pieces that are non-zero at position ``u`` of an interval."""
    return [(1.0 - u) * (1.0 - u) * (1.0 - u) / 6.0,
            (u * u * u * 3.0 - u * u * 6.0 + 4.0) / 6.0,
            (u * u * u * -3.0 + u * u * 3.0 + u * 3.0 + 1.0) / 6.0,
            u * u * u / 6.0]


def _design(x: np.ndarray, lo: float, step: float, intervals: int) -> np.ndarray:
    t = (x - lo) / step
    j = np.clip(np.floor(t), 0, intervals - 1).astype(int)
    out = np.zeros((len(x), intervals + ORDER))
    for k, w in enumerate(_weights(t - j)):
        out[np.arange(len(x)), j + k] = w
    return out


def _matrix(pdf: pd.DataFrame, predictors, lows, steps, intervals) -> np.ndarray:
    parts = [np.ones((len(pdf), 1))]
    parts += [_design(pdf[p].to_numpy(float), lo, st, intervals) for p, lo, st in zip(predictors, lows, steps)]
    return np.hstack(parts)


def fit(df, predictors, label, seed, n_splines, penalty, max_iter) -> Model:
    if n_splines <= ORDER:
        raise ValueError(f"a cubic spline needs more than {ORDER} pieces")
    rows = training_rows(df, predictors, label).persist()
    try:
        r = rows.agg(F.count(F.lit(1)), F.count_if(F.col("label") == 1),
                     *[f(p) for p in predictors for f in (F.min, F.max)]).first()
        if not r[0] or r[1] in (0, r[0]):
            raise ValueError("fitting needs complete records of both classes")
        intervals = n_splines - ORDER
        lows, highs = list(r[2::2]), list(r[3::2])
        steps = [(h - l) / intervals if h > l else 1.0 for l, h in zip(lows, highs)]
        size = 1 + n_splines * len(predictors)
        bend = np.diff(np.eye(n_splines), 2, axis=0)
        smooth = np.zeros((size, size))
        for i in range(len(predictors)):
            at = slice(1 + i * n_splines, 1 + (i + 1) * n_splines)
            smooth[at, at] = penalty * bend.T @ bend
        smooth += RIDGE * np.eye(size)
        share = r[1] / r[0]
        beta = np.zeros(size)
        beta[0] = np.log(share / (1 - share))
        for _ in range(max_iter):
            gram, moment = _sums(rows, predictors, lows, steps, intervals, beta)
            new = np.linalg.solve(gram + smooth, moment)
            change = np.linalg.norm(new - beta) / max(np.linalg.norm(new), 1e-12)
            beta = new
            if change < TOLERANCE:
                break
    finally:
        rows.unpersist()
    return Model("gam", predictors, {"n_splines": n_splines, "penalty": penalty, "max_iter": max_iter},
                 {"lows": lows, "steps": steps, "intervals": intervals, "coef": beta.tolist()})


def _sums(rows, predictors, lows, steps, intervals, beta):
    """X'WX and X'Wz at the current coefficients: summed per task, then over tasks."""
    size = len(beta)

    def per_task(batches):
        total = np.zeros(size * (size + 1))
        for pdf in batches:
            x, y = _matrix(pdf, predictors, lows, steps, intervals), pdf["label"].to_numpy(float)
            eta = np.clip(x @ beta, -30, 30)
            mu = 1.0 / (1.0 + np.exp(-eta))
            w = np.maximum(mu * (1 - mu), 1e-10)
            wx = x * w[:, None]
            total += np.concatenate([(x.T @ wx).ravel(), wx.T @ (eta + (y - mu) / w)])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    sums = rows.mapInPandas(per_task, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(size * (size + 1))
    for r in sums.collect():
        flat[r.i] = r.v
    return flat[:size * size].reshape(size, size), flat[size * size:]


def _pieces(coef) -> np.ndarray:
    """Polynomial coefficients (constant first) of the curve on each interval."""
    unit = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6.0
    c = np.asarray(coef)
    return np.array([c[j:j + ORDER + 1] @ unit for j in range(len(c) - ORDER)])


def _smooth_term(col, lo, step, intervals, coef):
    high = lo + step * intervals
    inside = F.least(F.lit(high), F.greatest(F.lit(lo), col))
    t = (inside - lo) / step
    j = F.least(F.lit(intervals), F.floor(t).cast("int") + 1)  # 1-based interval
    u = t - (j - 1)
    constant, *powers = [F.element_at(F.array(*[F.lit(float(v)) for v in k]), j) for k in _pieces(coef).T]
    value = powers[2]
    for k in (powers[1], powers[0], constant):
        value = value * u + k
    # Beyond the training range the curve goes on straight.
    left, right = (coef[2] - coef[0]) / (2 * step), (coef[-1] - coef[-3]) / (2 * step)
    slope = F.when(col < lo, F.lit(float(left))).otherwise(F.lit(float(right)))
    return value + slope * (col - inside)


def _probability(model: Model):
    st, n = model.state, model.params["n_splines"]
    eta = F.lit(st["coef"][0])
    for i, p in enumerate(model.predictors):
        coef = st["coef"][1 + i * n:1 + (i + 1) * n]
        eta = eta + _smooth_term(F.col(p), st["lows"][i], st["steps"][i], st["intervals"], coef)
    return F.nanvl(logistic(eta), F.lit(0.5))


score = by_formula(_probability)

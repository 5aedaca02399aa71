"""Maximum entropy: penalised density ratio of presences to background over expanded features.

Rows are packed once. Each round is one distributed pass: a task expands the features of a pack, sums the weighted loss, its
gradient and its curvature, and forgets them, so the expanded table is never stored. Newton steps on these sums, with the
penalty taken coefficient by coefficient, reach the optimum in a few rounds; only the sums come to the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .base import Model, by_formula, training_rows, weighted_sum
from .rounds import packed, summed

DEFAULTS = {"feature_types": None, "beta_multiplier": 1.5, "n_hinge_features": 10, "max_iter": 200}
CLASSES = ("linear", "quadratic", "hinge", "product", "threshold")
# Presence counts at which a feature class joins, case weights, and the published
# penalty tables (presence count -> penalty, linear in between).
CLASS_FROM = {"linear": 0, "quadratic": 10, "hinge": 15, "product": 80}
PRESENCE_WEIGHT = 1.0
BACKGROUND_WEIGHT = 100.0
PENALTY = {
    "linear": ([0, 10, 30, 100], [1.0, 1.0, 0.2, 0.05]),
    "quadratic": ([0, 10, 17, 30, 100], [1.3, 0.8, 0.5, 0.25, 0.05]),
    "product": ([0, 10, 17, 30, 100], [2.6, 1.6, 0.9, 0.55, 0.05]),
    "hinge": ([0, 1], [0.5, 0.5]),
    "threshold": ([0, 100], [2.0, 1.0]),
}
PENALTY_FLOOR = 0.001
SETTLED = 1e-8  # what an optimum's conditions may be missed by, per unit of case weight
GAIN = 1e-12  # share of the loss that a step must promise
SWEEPS, SWEPT = 2000, 1e-9  # passes over the coefficients for one step, and the change of the model that ends them


def feature_classes(n_presence: int) -> tuple[str, ...]:
    """Feature classes for a sample size; thresholds only ever on request."""
    return tuple(c for c in CLASSES if c in CLASS_FROM and n_presence >= CLASS_FROM[c])


def feature_classes_column(n_presence):
    """The same rule as a column, for many species at once."""
    wanted = [F.when(n_presence >= start, F.lit(c)) for c, start in CLASS_FROM.items()]
    return F.array_compact(F.array(*wanted))


def _unit(predictors, lows, highs):
    """Predictors scaled to, and clamped at, [0, 1]."""
    return [F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(p) - lo) / (hi - lo if hi > lo else 1.0)))
            for p, lo, hi in zip(predictors, lows, highs)]


def _layout(p: int, classes, knots: int) -> list[str]:
    """Class of every feature, in the order ``expanded`` builds them."""
    sizes = {"linear": p, "quadratic": p, "product": p * (p - 1) // 2, "hinge": 2 * p * knots,
             "threshold": p * (knots - 1)}
    return [c for c in sizes if c in classes for _ in range(sizes[c])]


def expanded(x: np.ndarray, lows, highs, classes, knots: int) -> np.ndarray:
    """All features of a batch of rows: linear, quadratic, product, hinge, threshold."""
    lows, highs = np.asarray(lows), np.asarray(highs)
    u = np.clip((x - lows) / np.where(highs > lows, highs - lows, 1.0), 0.0, 1.0)
    parts, starts = [], np.arange(knots) / knots
    if "linear" in classes:
        parts.append(u)
    if "quadratic" in classes:
        parts.append(u * u)
    if "product" in classes and u.shape[1] > 1:
        parts.append(np.stack([u[:, a] * u[:, b] for a, b in combinations(range(u.shape[1]), 2)], axis=1))
    if "hinge" in classes:  # rising from each knot, then falling towards each mirrored knot
        for side in (u, 1.0 - u):
            parts.append((np.maximum(0.0, side[:, :, None] - starts) / (1.0 - starts)).reshape(len(u), -1))
    if "threshold" in classes:
        parts.append((u[:, :, None] >= starts[1:]).astype(float).reshape(len(u), -1))
    return np.hstack(parts)


def _expanded(unit, classes, knots: int):
    """The same features of a row as an array column."""
    parts, every = [], F.array(*unit)
    starts = F.array(*[F.lit(i / knots) for i in range(knots)])
    if "linear" in classes:
        parts.append(every)
    if "quadratic" in classes:
        parts.append(F.transform(every, lambda u: u * u))
    if "product" in classes and len(unit) > 1:
        parts.append(F.array(*[a * b for a, b in combinations(unit, 2)]))
    if "hinge" in classes:  # rising from each knot, then falling towards each mirrored knot
        for side in (lambda u: u, lambda u: 1.0 - u):
            parts.append(F.flatten(F.transform(every, lambda u: F.transform(
                starts, lambda k: F.greatest(F.lit(0.0), (side(u) - k) / (1.0 - k))))))
    if "threshold" in classes:
        inner = F.slice(starts, 2, knots - 1)
        parts.append(F.flatten(F.transform(every, lambda u: F.transform(
            inner, lambda k: F.when(u >= k, 1.0).otherwise(0.0)))))
    return F.concat(*parts)


def sums_at(z: np.ndarray, y: np.ndarray, theta: np.ndarray):
    """Weighted loss, its gradient and curvature of a batch; the last column of ``z`` is the offset's."""
    eta = z @ theta
    weight = np.where(y == 1, PRESENCE_WEIGHT, BACKGROUND_WEIGHT)
    mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
    bend = z * np.sqrt(weight * mu * (1 - mu))[:, None]
    return np.concatenate([[(weight * (np.logaddexp(0.0, eta) - y * eta)).sum()], z.T @ (weight * (mu - y)), (bend.T @ bend).ravel()])


def _step(theta, gradient, curvature, pull):
    """Where the quadratic model of the loss plus ``pull * |theta|`` is least, coefficient by coefficient."""
    new, slope, diagonal = theta.copy(), gradient.copy(), np.diag(curvature)
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(len(theta)):
            at = new[j] - slope[j] / diagonal[j]
            at = np.sign(at) * max(abs(at) - pull[j] / diagonal[j], 0.0)
            if at != new[j]:
                shift = at - new[j]
                new[j] = at
                slope += curvature[j] * shift
                moved = max(moved, diagonal[j] * shift * shift)
        if moved <= SWEPT:
            break
    return new


def violation(theta, gradient, pull) -> float:
    """How far the conditions of the optimum are missed, by the coefficient that misses them most."""
    return float(np.where(theta != 0, np.abs(gradient + pull * np.sign(theta)), np.maximum(0.0, np.abs(gradient) - pull)).max())


def _solve(at, theta, pull, scale, max_iter):
    """Newton steps on the penalised loss, halved until they help."""
    value, gradient, curvature = at(theta)
    value += float(pull @ np.abs(theta))
    rounds = 1
    while rounds < max_iter and violation(theta, gradient, pull) > SETTLED * scale:
        held = curvature + np.diag(np.full(len(theta), 1e-10 * np.diag(curvature).max()))
        goal, share = _step(theta, gradient, held, pull), 1.0
        expected = float(gradient @ (goal - theta) + pull @ (np.abs(goal) - np.abs(theta)))
        if -expected <= GAIN * abs(value):
            break
        while rounds < max_iter:
            tried = theta + share * (goal - theta)
            other = at(tried)
            total, rounds = other[0] + float(pull @ np.abs(tried)), rounds + 1
            if total <= value + 1e-4 * share * expected:
                theta, value, (_, gradient, curvature) = tried, total, other
                break
            share /= 2
            if share < 1e-6:
                return theta
    return theta


def fit(df, predictors, label, seed, feature_types, beta_multiplier, n_hinge_features, max_iter) -> Model:
    rows = training_rows(df, predictors, label)
    packs = packed(rows, [*predictors, "label"]).persist()
    p = len(predictors)
    try:
        kind = [F.min] * p + [F.max] * p + [F.sum] * 2
        ends = packs.mapInPandas(_ends(p), ", ".join(f"v{i} double" for i in range(2 * p + 2)))
        r = ends.agg(*[f(f"v{i}") for i, f in enumerate(kind)]).first()
        n, n1 = int(r[2 * p] or 0), int(r[2 * p + 1] or 0)
        if not n or n1 in (0, n):
            raise ValueError("fitting needs complete records of both classes")
        lows, highs = list(r[:p]), list(r[p:2 * p])
        classes = tuple(feature_types) if feature_types else feature_classes(n1)
        if set(classes) - set(CLASSES):
            raise ValueError(f"feature classes must be among {CLASSES}")
        kinds = _layout(p, classes, n_hinge_features)
        size = len(kinds)

        def spread(x):
            z = expanded(x[x[:, p] == 1, :p], lows, highs, classes, n_hinge_features)
            return np.concatenate([z.sum(axis=0), (z * z).sum(axis=0)])

        first, second = np.split(summed(packs, p + 1, 2 * size, spread), 2)
        std = np.sqrt(np.maximum(0.0, second - first * first / n1) / max(1, n1 - 1))
        base = np.array([np.interp(n1, *PENALTY[c]) for c in kinds])
        penalty = np.maximum(beta_multiplier * base * std / np.sqrt(n1), PENALTY_FLOOR)
        # The offset, last, carries no penalty.
        pull = np.append(n1 * penalty, 0.0)

        def at(theta):
            def sums(x):
                z = expanded(x[:, :p], lows, highs, classes, n_hinge_features)
                return sums_at(np.hstack([z, np.ones((len(z), 1))]), x[:, p], theta)
            flat = summed(packs, p + 1, 1 + (size + 1) * (size + 2), sums)
            return flat[0], flat[1:size + 2], flat[size + 2:].reshape(size + 1, size + 1)

        total = n1 * PRESENCE_WEIGHT + (n - n1) * BACKGROUND_WEIGHT
        start = np.append(np.zeros(size), np.log(n1 * PRESENCE_WEIGHT / ((n - n1) * BACKGROUND_WEIGHT)))
        theta = _solve(at, start, pull, total, max_iter)
        state = {"lows": lows, "highs": highs, "classes": list(classes), "coef": theta[:-1].tolist()}
        # Normalise to a density over the background and take its entropy.
        coef = theta[:-1]

        def tops(batches):
            for pdf in batches:
                for pack in pdf["pack"]:
                    x = np.frombuffer(pack).reshape(-1, p + 1)
                    eta = expanded(x[x[:, p] == 0, :p], lows, highs, classes, n_hinge_features) @ coef
                    if len(eta):
                        e = np.exp(eta - eta.max())
                        yield pd.DataFrame({"top": [eta.max()], "mass": [e.sum()], "tilt": [(e * eta).sum()]})

        per_pack = packs.mapInPandas(tops, "top double, mass double, tilt double")
        top = per_pack.agg(F.max("top")).first()[0]
        mass, tilt = per_pack.agg(F.sum(F.exp(F.col("top") - top) * F.col("mass")), F.sum(F.exp(F.col("top") - top) * F.col("tilt"))).first()
    finally:
        packs.unpersist()
    log_mass = float(np.log(mass) + top)
    state["shift"] = -log_mass + (log_mass - tilt / mass)
    return Model("maxent", predictors, {"feature_types": feature_types, "beta_multiplier": beta_multiplier,
                                        "n_hinge_features": n_hinge_features, "max_iter": max_iter}, state)


def _ends(p: int):
    """Per task: least and greatest value of each predictor, records and presences."""
    def ends(batches):
        low, high, n, n1 = np.full(p, np.inf), np.full(p, -np.inf), 0, 0
        for pdf in batches:
            for pack in pdf["pack"]:
                x = np.frombuffer(pack).reshape(-1, p + 1)
                low, high = np.minimum(low, x[:, :p].min(axis=0)), np.maximum(high, x[:, :p].max(axis=0))
                n, n1 = n + len(x), n1 + int((x[:, p] == 1).sum())
        if n:
            yield pd.DataFrame([[*low, *high, n, n1]], columns=[f"v{i}" for i in range(2 * p + 2)], dtype=float)
    return ends


def _linear(model: Model):
    """The fitted sum. Hinges and thresholds share one knot grid, so per predictor they add up to
    a table of values at the knots: straight lines between them, plus steps at them."""
    st, knots = model.state, model.params["n_hinge_features"]
    unit = _unit(model.predictors, st["lows"], st["highs"])
    p, at, coef = len(unit), 0, np.asarray(st["coef"])
    eta = F.lit(0.0)

    def take(n):
        nonlocal at
        at += n
        return coef[at - n:at]

    if "linear" in st["classes"]:
        eta = weighted_sum(unit, take(p))
    if "quadratic" in st["classes"]:
        eta = eta + weighted_sum([u * u for u in unit], take(p))
    if "product" in st["classes"] and p > 1:
        eta = eta + weighted_sum([a * b for a, b in combinations(unit, 2)], take(p * (p - 1) // 2))
    nodes, starts = np.arange(knots + 1) / knots, np.arange(knots) / knots
    ramp = np.maximum(0.0, (nodes[:, None] - starts) / (1.0 - starts))
    if "hinge" in st["classes"]:
        lines = take(p * knots).reshape(p, knots) @ ramp.T + take(p * knots).reshape(p, knots) @ ramp[::-1].T
        for u, line in zip(unit, lines):
            j = F.least(F.lit(knots), F.floor(u * knots).cast("int") + 1)
            held, rise = (F.array(*[F.lit(float(v)) for v in t]) for t in (line[:-1], np.diff(line)))
            eta = eta + F.element_at(held, j) + F.element_at(rise, j) * (u * knots - (j - 1))
    if "threshold" in st["classes"]:
        for u, step in zip(unit, take(p * (knots - 1)).reshape(p, knots - 1)):
            passed = [F.when(u >= k, F.lit(float(w))).otherwise(0.0) for k, w in zip(starts[1:], step)]
            eta = eta + weighted_sum(passed, np.ones(len(passed)))
    return eta


score = by_formula(lambda m: 1.0 - F.exp(-F.exp(_linear(m) + m.state["shift"])))

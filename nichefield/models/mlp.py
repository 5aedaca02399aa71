"""Perceptron with one small hidden layer of rectified units and weight decay, on standardised predictors.

Each round is one distributed pass over the rows: the penalised loss, its gradient by a forward and a backward pass over
whole batches, and the Gauss-Newton curvature, summed per task and then over tasks. Damped Newton steps on these sums reach
an optimum in about a hundred rounds; only the sums come to the driver, whose size is the square of the number of weights.
A bounded number of rows takes its rounds inside one task, which is one job instead of one a round.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .base import Model, by_formula, logistic, standard_columns, training_rows, weighted_sum
from .rounds import packed, share_of, summed

DEFAULTS = {"hidden": 8, "alpha": 0.01, "max_iter": 500}
SETTLED = 1e-7  # largest component of the gradient, per row, at which the weights count as settled
START_ROWS = 100_000  # rows, about, on which the first rounds are taken when there are more; half as many again may lie in one task
BLOCK = 2048  # rows of which slopes are held at once: they stay in the processor's cache
STALLED, GAIN = 20, 1e-6  # rounds that together must lower the loss by this share; at a bend of a unit the gradient need not vanish


def _unpacked(theta, inputs: int, hidden: int):
    """(weights into the units, their offsets, weights out of them, last offset)."""
    cut = inputs * hidden
    return theta[:cut].reshape(inputs, hidden), theta[cut:cut + hidden], theta[cut + hidden:cut + 2 * hidden], theta[-1]


def _start(inputs: int, hidden: int, seed: int, share: float) -> np.ndarray:
    """Small random weights, the spread by the number of connections, and the offset of the overall share."""
    rng, spread = np.random.default_rng(seed), np.sqrt(6.0 / (inputs + hidden))
    out = np.sqrt(6.0 / (hidden + 1))
    return np.concatenate([rng.uniform(-spread, spread, inputs * hidden), rng.uniform(-spread, spread, hidden), rng.uniform(-out, out, hidden) * 0.1, [np.log(share / (1 - share))]])


def decayed(inputs: int, hidden: int) -> np.ndarray:
    """1 for the weights that decay: all but the offsets."""
    return np.concatenate([np.ones(inputs * hidden), np.zeros(hidden), np.ones(hidden), [0.0]])


def passes(z: np.ndarray, y: np.ndarray, theta: np.ndarray, hidden: int):
    """(loss, gradient, curvature) of a batch, without the decay."""
    (weights, offsets, out, last), inputs, size = _unpacked(theta, z.shape[1], hidden), z.shape[1], len(theta)
    loss, gradient, curvature, held = 0.0, np.zeros(size), np.zeros((size, size)), np.empty((min(BLOCK, len(z)), size))
    for i in range(0, len(z), BLOCK):
        x, seen = z[i:i + BLOCK], y[i:i + BLOCK]
        slope = held[:len(x)]
        back, h = slope[:, inputs * hidden:-1 - hidden], slope[:, -1 - hidden:-1]
        a = x @ weights + offsets
        np.multiply(a > 0, out, out=back)
        np.maximum(a, 0.0, out=h)
        for j in range(inputs):
            np.multiply(back, x[:, j:j + 1], out=slope[:, j * hidden:(j + 1) * hidden])
        slope[:, -1] = 1.0
        eta = np.clip(h @ out + last, -500, 500)
        mu = 1.0 / (1.0 + np.exp(-eta))
        loss += float((np.logaddexp(0.0, eta) - seen * eta).sum())
        gradient += (mu - seen) @ slope
        slope *= np.sqrt(mu * (1 - mu))[:, None]
        curvature += slope.T @ slope
    return loss, gradient, curvature


def _sums(packs, inputs, mean, sd, theta, hidden):
    """Loss, gradient and curvature over all packed rows."""
    size = len(theta)

    def sums(x):
        loss, gradient, curvature = passes((x[:, :inputs] - mean) / sd, x[:, inputs], theta, hidden)
        return np.concatenate([[loss], gradient, curvature.ravel()])

    flat = summed(packs, inputs + 1, 1 + size + size * size, sums)
    return flat[0], flat[1:1 + size], flat[1 + size:].reshape(size, size)


def _settle(at, theta, n, rounds, stalled=STALLED, gain=GAIN):
    """(weights, rounds taken): damped Newton steps until the gradient has settled or the loss no longer falls.

    After a refused step the damping stays until a step does what the curvature foretold, else every second step is refused."""
    value, gradient, curvature = at(theta)
    damping, refused, seen = 1e-3 * n, False, [value]
    while len(seen) < rounds:
        if np.abs(gradient).max() <= SETTLED * n or (len(seen) > stalled and seen[-stalled - 1] - value < gain * value):
            break
        step = -np.linalg.solve(curvature + damping * np.eye(len(theta)), gradient)
        other = at(theta + step)
        if other[0] < value:
            foretold = -(gradient @ step + 0.5 * step @ curvature @ step)
            if not refused or value - other[0] > 0.75 * foretold:
                damping = max(damping / 4, 1e-9 * n)
            theta, (value, gradient, curvature), refused = theta + step, other, False
        else:
            damping, refused = damping * 5, True
        seen.append(value)
    return theta, len(seen)


def _penalised(sums, decay):
    """The function of the weights that ``_settle`` takes: what ``sums`` gives, with the decay."""
    def at(theta):
        loss, gradient, curvature = sums(theta)
        return loss + 0.5 * float(decay @ theta ** 2), gradient + decay * theta, curvature + np.diag(decay)
    return at


def _settled_in_task(packs, inputs, mean, sd, theta, hidden, decay, rounds):
    """The weights after all rounds over a bounded number of packed rows, taken in one task."""
    def walk(batches):
        x = np.concatenate([np.frombuffer(pack).reshape(-1, inputs + 1) for pdf in batches for pack in pdf["pack"]])
        x = x[np.lexsort(x.T)]  # the order of sums, and so the weights, do not depend on how rows were packed
        z, y = (x[:, :inputs] - mean) / sd, np.ascontiguousarray(x[:, inputs])
        done, _ = _settle(_penalised(lambda t: passes(z, y, t, hidden), decay), theta, len(x), rounds)
        yield pd.DataFrame({"theta": [done.tobytes()]})

    return np.frombuffer(bytes(packs.repartition(1).mapInPandas(walk, "theta binary").first().theta))


def fit(df, predictors, label, seed, hidden, alpha, max_iter) -> Model:
    rows, inputs = training_rows(df, predictors, label), len(predictors)
    packs = packed(rows, [*predictors, "label"]).persist()
    try:
        mean, sd, n, n1 = _moments(packs, inputs)
        decay, theta = alpha * decayed(inputs, hidden), _start(inputs, hidden, seed, n1 / n)

        def settled(some, held, theta, **stop):
            if held <= 1.5 * START_ROWS:
                return _settled_in_task(some, inputs, mean, sd, theta, hidden, decay, max_iter)
            return _settle(_penalised(lambda t: _sums(some, inputs, mean, sd, t, hidden), decay), theta, held, max_iter, **stop)[0]

        # The way from random weights is walked on a share of the rows and then on a larger one; all rows decide where it ends.
        for share in _shares(n):
            part = share_of(packs, inputs + 1, share).persist()
            try:
                held = int(summed(part, inputs + 1, 1, lambda x: np.array([float(len(x))]))[0])  # few distinct rows may leave none
                if held:
                    theta = settled(part, held, theta, stalled=STALLED // 2, gain=100 * GAIN)
            finally:
                part.unpersist()
        theta = settled(packs, n, theta)
    finally:
        packs.unpersist()
    return Model("mlp", predictors, {"hidden": hidden, "alpha": alpha, "max_iter": max_iter}, {"mean": mean.tolist(), "sd": sd.tolist(), "theta": theta.tolist()})


def _shares(n: int) -> list[int]:
    """One in how many rows the rounds before the last are taken on: about ``START_ROWS``, then halfway to all in powers."""
    if n <= START_ROWS:
        return []
    first = max(2, n // START_ROWS)
    return [first, *[s for s in [math.isqrt(first)] if 1 < s < first]]


def _moments(packs, inputs: int):
    """Means, population spreads (1 for a constant), rows and presences, in two passes."""
    first = summed(packs, inputs + 1, inputs + 2, lambda x: np.concatenate([x[:, :inputs].sum(axis=0), [len(x), (x[:, inputs] == 1).sum()]]))
    n, n1 = int(first[-2]), int(first[-1])
    if not n or n1 in (0, n):
        raise ValueError("fitting needs complete records of both classes")
    mean = first[:inputs] / n
    sd = np.sqrt(summed(packs, inputs + 1, inputs, lambda x: ((x[:, :inputs] - mean) ** 2).sum(axis=0)) / n)
    return mean, np.where(sd < 1e-12, 1.0, sd), n, n1


def hidden_units(model: Model):
    """The rectified units as columns."""
    st, hidden = model.state, model.params["hidden"]
    weights, offsets, *_ = _unpacked(np.array(st["theta"]), len(model.predictors), hidden)
    z = standard_columns(model.predictors, st["mean"], st["sd"])
    return [F.greatest(F.lit(0.0), weighted_sum(z, weights[:, k], offsets[k])) for k in range(hidden)]


def _probability(model: Model):
    *_, out, last = _unpacked(np.array(model.state["theta"]), len(model.predictors), model.params["hidden"])
    return logistic(weighted_sum(hidden_units(model), out, last))


score = by_formula(_probability)

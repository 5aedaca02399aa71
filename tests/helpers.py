"""Values and comparisons that the tests share."""

import math

BANDS = ["band_0", "band_1", "band_2"]


def uniform(n, seed, low=0.0, high=1.0):
    import numpy as np
    return np.random.default_rng(seed).uniform(low, high, n)


def close(a, b, tol=1e-9):
    return (a is None and b is None) or math.isclose(a, b, rel_tol=tol, abs_tol=tol)

"""Isotope distributions: convolution as a column function, and the same kernels in numpy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def convolve(a: Column, b: Column) -> Column:
    """Convolution of two arrays of probabilities. Both are bound once, so an argument that is computed
    is not computed again for every product."""

    def both(x):
        p, q = x["a"], x["b"]
        places = lambda k: F.sequence(F.greatest(F.lit(0), k - F.size(q) + 1), F.least(k, F.size(p) - 1))
        one = lambda k: F.aggregate(places(k), F.lit(0.0), lambda s, i: s + F.get(p, i) * F.get(q, k - i))
        return F.transform(F.sequence(F.lit(0), F.size(p) + F.size(q) - 2), one)

    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), both), F.lit(0))


def convolve_peaks(masses_a, probs_a, masses_b, probs_b, least: float = 1e-6):
    """Sum of two distributions: probabilities convolve, masses are their weighted means."""
    import numpy as np

    p = np.convolve(probs_a, probs_b)
    m = np.convolve(np.multiply(masses_a, probs_a), probs_b) + np.convolve(probs_a, np.multiply(masses_b, probs_b))
    keep = p >= least
    return m[keep] / p[keep], p[keep]


def power(masses, probs, n: int, least: float = 1e-6):
    """n times a distribution, by squaring."""
    import numpy as np

    out = (np.array([0.0]), np.array([1.0]))
    base = (np.asarray(masses, float), np.asarray(probs, float))
    while n:
        if n & 1:
            out = convolve_peaks(*out, *base, least)
        n >>= 1
        if n:
            base = convolve_peaks(*base, *base, least)
    return out

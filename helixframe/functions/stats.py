"""Probability functions as vectorised pandas functions; arithmetic that SQL functions can express stays in column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def lgamma_array(x: np.ndarray) -> np.ndarray:
    """Named in this module, so that functions shipped to workers refer to it and don't carry the vectorised object, which can't be pickled once used."""
    return _lgamma(np.asarray(x, float))


def normal_cdf_array(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def poisson_pmf_array(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    k, mean = np.broadcast_arrays(np.asarray(k, float), np.asarray(mean, float))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.exp(k * np.log(mean) - mean - _lgamma(k + 1))
    return np.where(mean == 0, (k == 0).astype(float), np.where(k < 0, 0.0, out))


def poisson_cdf_one(k: float, mean: float) -> float:
    """P(X <= k), by summing the terms from the largest k down."""
    if k < 0:
        return 0.0
    if mean <= 0:
        return 1.0
    n = int(k)
    term = total = math.exp(n * math.log(mean) - mean - math.lgamma(n + 1))
    for i in range(n, 0, -1):
        term *= i / mean
        total += term
        if term < total * 1e-17 and i < mean:
            break
    return min(1.0, total)


def binomial_cdf_one(k: float, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(int(k) + 1)
    return float(min(1.0, np.exp(math.lgamma(n + 1) - _lgamma(i + 1) - _lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def poisson_noise_one(observed: float, probability: float, tolerance: float = 1e-6) -> float:
    """The mean for which P(X <= observed) is ``probability``, by bisection."""
    low, high = 0.0, max(10.0, 4.0 * (observed + 1))
    for _ in range(200):
        mid = (low + high) / 2
        found = poisson_cdf_one(observed, mid)
        if abs(found - probability) < tolerance:
            return mid
        low, high = (mid, high) if found > probability else (low, mid)
    return (low + high) / 2


def fisher_one(a: int, b: int, c: int, d: int, most: int = 10_000) -> float:
    """One-sided exact test of [[a, b], [c, d]]: the right tail where a exceeds its expectation, else the left; NaN over ``most`` in all."""
    n = a + b + c + d
    if n > most:
        return math.nan
    if n == 0:
        return 1.0
    rows, columns = a + b, a + c
    low, high = max(0, rows + columns - n), min(rows, columns)
    x = np.arange(low, high + 1)
    whole = math.lgamma(rows + 1) + math.lgamma(n - rows + 1) + math.lgamma(columns + 1) + math.lgamma(n - columns + 1) - math.lgamma(n + 1)
    p = np.exp(whole - _lgamma(x + 1) - _lgamma(rows - x + 1) - _lgamma(columns - x + 1) - _lgamma(n - rows - columns + x + 1))
    return float(min(1.0, p[x >= a].sum() if a * n > rows * columns else p[x <= a].sum()))


def _vectorised(f):
    """A column function whose pandas function is made when it is called, so that executors can import this module."""

    def build(*columns) -> Column:
        @F.pandas_udf("double")
        def run(*values: pd.Series) -> pd.Series:
            return pd.Series(f(*[v.to_numpy() for v in values]))

        return run(*columns)

    return build


def _each(f):
    def rows(*columns: np.ndarray) -> np.ndarray:
        return np.array([math.nan if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns)], float)

    return _vectorised(rows)


normal_cdf = _vectorised(normal_cdf_array)
poisson_pmf = _vectorised(poisson_pmf_array)
poisson_cdf = _each(poisson_cdf_one)
binomial_cdf = _each(lambda k, n, p: binomial_cdf_one(k, int(n), p))
poisson_noise = _each(poisson_noise_one)
fisher_exact = _each(lambda a, b, c, d: fisher_one(int(a), int(b), int(c), int(d)))


def phred(error: Column) -> Column:
    return -10 * F.log10(error)


def error_of(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / 10)


def cosine(a: Column, b: Column, skip_zeros: bool = False) -> Column:
    """Cosine similarity of two arrays, 1 at most; 0 under two usable places. skip_zeros leaves out places where either is zero."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    if skip_zeros:
        pairs = F.filter(pairs, lambda p: (p["x"] != 0) & (p["y"] != 0))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"), F.lit(0).alias("n"))
    sums = F.aggregate(pairs, zero, lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"), (s["n"] + 1).alias("n")))
    return F.when((sums["n"] < 2) | (sums["xx"] == 0) | (sums["yy"] == 0), 0.0).otherwise(F.least(F.lit(1.0), sums["xy"] / F.sqrt(sums["xx"] * sums["yy"])))


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the points (xs ascending), flat beyond the ends."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 2, -1, -1):
        line = ys[i] + (x - xs[i]) * ((ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]))
        out = F.when(x < xs[i + 1], line).otherwise(out)
    return F.when(x <= xs[0], float(ys[0])).otherwise(out)


def stepped(x: Column, cuts: list[float], values: list[float]) -> Column:
    """A step function: values[i] below cuts[i], the last value from the last cut on."""
    out = F.lit(float(values[-1]))
    for c, v in zip(reversed(cuts), reversed(values[:-1])):
        out = F.when(x < c, float(v)).otherwise(out)
    return out

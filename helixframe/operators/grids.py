"""Grid searches as joins with a broadcast grid of bounded size, reduced by sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import lgamma_array, poisson_pmf_array


def purity_grid(spark: SparkSession, low: float = 0.08, high: float = 1.0, step: float = 0.01, ploidies: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """(purity, ploidy): purities low to high; ploidies in steps that widen upwards."""
    purities = [round(low + step * i, 6) for i in range(int(round((high - low) / step)) + 1)]
    spans = ploidies or [(1.0, 3.0, 0.02), (3.0, 5.0, 0.05), (5.0, 8.0, 0.1)]
    values = [round(a + s * i, 6) for a, b, s in spans for i in range(int(round((b - a) / s)))] + [spans[-1][1]]
    return spark.createDataFrame([(p, q) for p in purities for q in values], "purity double, ploidy double")


def purity_scores(regions: DataFrame, grid: DataFrame, ratio: str, baf: str, weight: str, average: float = 1.0) -> DataFrame:
    """(purity, ploidy, score): for each candidate, the mean event penalty times the mean distance to whole copies, weighted.

    The regions may be many; the grid has a few ten thousand rows and is broadcast, and sums are taken before the shuffle.
    """
    p, q = F.col("purity"), F.col("ploidy")
    norm = 2 * average / (2 - 2 * p + q * p)
    total = 2 + 2 * (F.col(ratio) - norm) / p / norm
    major = (F.col(baf) * (p * total + 2 * (1 - p)) - (1 - p)) / p
    minor = total - major
    far = lambda x: F.when(x < -0.5, 0.5 + (-0.5 - x)).otherwise(F.abs(x - F.floor(x + 0.5)))
    single = F.abs(major - 1) + F.abs(minor - 1)
    event = 1 + 0.4 * F.least(single, 1 + F.abs(major - 2) + F.abs(minor - 2))
    w = F.col(weight)
    sums = regions.join(F.broadcast(grid), F.lit(True)).groupBy("purity", "ploidy").agg(F.sum(w).alias("w"), F.sum(w * event).alias("e"), F.sum(w * (far(major) + far(minor))).alias("d"))
    return sums.select("purity", "ploidy", (F.col("e") / F.col("w") * F.col("d") / F.col("w")).alias("score"))


def near_best(scores: DataFrame, relative: float = 0.1, absolute: float = 0.0005) -> DataFrame:
    """Candidates within (1 + relative) of the lowest score, or ``absolute`` above it."""
    best = scores.agg(F.min("score").alias("__b"))
    return scores.join(F.broadcast(best), F.lit(True)).filter((F.col("score") <= (1 + relative) * F.col("__b")) | (F.col("score") <= F.col("__b") + absolute)).drop("__b")


def fit_choice(scores: DataFrame, diploid: float, spread_limit: float = 0.15, least_diploid: float = 0.95) -> str:
    """NO_TUMOR without any score, SOMATIC where the tumor is almost all diploid and near-best purities spread widely, else NORMAL."""
    r = near_best(scores).agg(F.min("purity").alias("a"), F.max("purity").alias("b")).first()
    if r.a is None:
        return "NO_TUMOR"
    if diploid >= least_diploid and r.b - r.a >= spread_limit:
        return "SOMATIC"
    return "NORMAL"


def contamination(sites: DataFrame, support: str, count: str, depth: float, levels: list[float] | None = None) -> DataFrame:
    """(level, score): how far a Poisson mixture at each level lies from the histogram of sites by alternative support.

    The histogram has a row for each support; at half of the contaminated sites one allele differs, at a quarter both. Few sites (under ten, or all
    below 3 % of the total) give level 0.
    """
    levels = levels or [i / 1000 for i in range(1, 1001)]
    spark = sites.sparkSession
    hist = sites.groupBy(F.col(support).cast("long").alias("k")).agg(F.sum(count).alias("n"))

    @F.pandas_udf("double")
    def expected(k: pd.Series, level: pd.Series) -> pd.Series:
        x, mean = k.to_numpy(float), level.to_numpy(float) * depth
        return pd.Series(0.5 * poisson_pmf_array(x, mean / 2) + 0.25 * poisson_pmf_array(x, mean) + 0.25 * (x == 0))

    total = hist.agg(F.sum("n").alias("t"))
    grid = spark.createDataFrame([(x,) for x in levels], "level double")
    mixed = hist.join(F.broadcast(total), F.lit(True)).join(F.broadcast(grid), F.lit(True)).withColumn("m", expected("k", "level"))
    return mixed.groupBy("level").agg((F.sum(F.abs(F.col("n") / F.col("t") - F.col("m"))) + (1 - F.sum("m"))).alias("score"))


def tinc(variants: DataFrame, depth: str, support: str, frequency: str, levels: list[float], most: int = 10) -> DataFrame:
    """(level, score): sum over support 0 to ``most`` of how far observed counts are from binomial expectations at each level.

    Variants are first counted by depth, support and frequency, so the grid meets distinct rows only.
    """
    spark = variants.sparkSession
    shape = variants.groupBy(F.col(depth).cast("long").alias("dp"), F.round(frequency, 3).alias("af")).agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(x, k) for x in levels for k in range(most + 1)], "level double, k int")

    @F.pandas_udf("double")
    def binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        a, b, c = k.to_numpy(float), n.to_numpy(float), np.clip(p.to_numpy(float), 1e-12, 1 - 1e-12)
        return pd.Series(np.where(a > b, 0.0, np.exp(lgamma_array(b + 1) - lgamma_array(a + 1) - lgamma_array(np.maximum(b - a, 0) + 1) + a * np.log(c) + (b - a) * np.log1p(-c))))

    model = shape.join(F.broadcast(grid), F.lit(True)).groupBy("level", "k").agg(F.sum(F.col("n") * binomial("k", "dp", F.col("level") * F.col("af"))).alias("m"))
    seen = variants.filter(F.col(support) <= most).groupBy(F.col(support).cast("int").alias("k")).agg(F.count("*").alias("o"))
    return model.join(F.broadcast(seen), "k", "left").groupBy("level").agg(F.sum(F.abs(F.coalesce("o", F.lit(0)) - F.col("m"))).alias("score"))


def first_lowest(scores: DataFrame, level: str = "level", patience: int = 5) -> float:
    """The lowest score's level in ascending order, first on ties, giving up after ``patience`` worse levels. Grids are small."""
    best, at, worse = math.inf, 0.0, 0
    for r in scores.orderBy(level).collect():
        if r["score"] < best:
            best, at, worse = r["score"], r[level], 0
        elif (worse := worse + 1) >= patience:
            break
    return at

"""Cohort statistics: percentile vectors, ranks, frequencies, rank tests, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_vectors(rows: DataFrame, by: list[str], value: str, steps: int = 100) -> DataFrame:
    """(by, n, percentiles): steps + 1 values interpolated between order statistics; null and NaN left out."""
    good = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return good.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(value, F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("percentiles"))


def percentile_rank(vector: Column, value: Column) -> Column:
    """Place of a value in a percentile vector, 0 to 1.

    Between entries it is interpolated, on a run of equal entries it is their middle; outside, 0 and 1.
    """
    n = F.size(vector)
    below = F.size(F.filter(vector, lambda x: x < value))
    upto = F.size(F.filter(vector, lambda x: x <= value))
    low, high = F.get(vector, upto - 1), F.get(vector, upto)
    between = (upto - 1 + (value - low) / (high - low)) / (n - 1)
    on_run = (below + (upto - 1)) / 2 / (n - 1)
    return F.when(upto == 0, 0.0).when(below == n, 1.0).when(upto > below, on_run).otherwise(between)


def expression_distribution(rows: DataFrame, gene: str, cancer: str, value: str) -> DataFrame:
    """(gene, cancer, n, median, p90): per cancer type and, with cancer null, over all; one expansion by grouping sets."""
    return rows.groupingSets([[F.col(gene), F.col(cancer)], [F.col(gene)]], F.col(gene), F.col(cancer)).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.9).alias("p90"))


def frequency(rows: DataFrame, keys: list[str], sample: str, count: str, least_count: int, least_samples: int) -> DataFrame:
    """(keys, samples, total): distinct samples with at least ``least_count``, for keys with enough samples, and their total."""
    return rows.filter(F.col(count) >= least_count).groupBy(*keys).agg(F.count_distinct(sample).alias("samples"), F.sum(count).alias("total")).filter(F.col("samples") >= least_samples)


def false_discovery(rows: DataFrame, p: str, by: list[str], ties: list[str]) -> DataFrame:
    """The rows with ``q``: p times the number of tests over the rank, without a monotonic step."""
    order = Window.partitionBy(*by).orderBy(p, *ties)
    return rows.withColumn("q", F.col(p) * F.count("*").over(Window.partitionBy(*by)) / F.row_number().over(order))


def rank_sums(rows: DataFrame, by: list[str], group: Column, value: str, ties: list[str]) -> DataFrame:
    """(by, n1, n2, rank_sum, u, z) of the rows where ``group`` holds against the others.

    Zeros share their ranks' mean; equal values above zero are ranked in the order of ``ties``. z is the normal approximation without tie correction.
    """
    order = Window.partitionBy(*by).orderBy(value, *ties)
    zeros = F.sum((F.col(value) == 0).cast("long")).over(Window.partitionBy(*by))
    rank = F.when(F.col(value) == 0, (zeros + 1) / 2).otherwise(F.row_number().over(order))
    ranked = rows.select(*by, group.alias("__in"), rank.alias("__r"))
    sums = ranked.groupBy(*by).agg(F.count_if("__in").alias("n1"), F.count_if(~F.col("__in")).alias("n2"), F.sum(F.when(F.col("__in"), F.col("__r")).otherwise(0.0)).alias("rank_sum"))
    u = F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2
    spread = F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return sums.withColumn("u", u).withColumn("z", (F.col("u") - F.col("n1") * F.col("n2") / 2) / spread)


def auc(rows: DataFrame, by: list[str], positive: Column, score: str) -> DataFrame:
    """(by, auc): share of positive-negative pairs in order, ties counting half; from counts by score, never from pairs."""
    counts = rows.groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(*by, "p", "n", (F.col("p") * (before + F.col("n") / 2)).alias("w")).groupBy(*by).agg((F.sum("w") / F.sum("p") / F.sum("n")).alias("auc"))


def linear_fit(rows: DataFrame, by: list[str], x: str, y: str, weight: str) -> DataFrame:
    """(by, slope, intercept) of the weighted least-squares line, from sums."""
    w, a, b = F.col(weight), F.col(x), F.col(y)
    s = rows.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * a).alias("x"), F.sum(w * b).alias("y"), F.sum(w * a * a).alias("xx"), F.sum(w * a * b).alias("xy"))
    slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("w")) / (F.col("xx") - F.col("x") * F.col("x") / F.col("w"))
    return s.select(*by, slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("w")).alias("intercept"))


def cubic_fit(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, a, b) of y = a x + b x**3 by least squares, from the normal equations' sums."""
    p, q = F.col(x), F.col(y)
    s = rows.groupBy(*by).agg(F.sum(p * p).alias("s2"), F.sum(p**4).alias("s4"), F.sum(p**6).alias("s6"), F.sum(p * q).alias("t1"), F.sum(p**3 * q).alias("t3"))
    det = F.col("s2") * F.col("s6") - F.col("s4") * F.col("s4")
    return s.select(*by, ((F.col("t1") * F.col("s6") - F.col("t3") * F.col("s4")) / det).alias("a"), ((F.col("s2") * F.col("t3") - F.col("s4") * F.col("t1")) / det).alias("b"))


def matched_pairs(genotypes: DataFrame, sample: str, site: str, genotype: str, least_sites: int, share: float) -> DataFrame:
    """(a, b, sites, matches) of sample pairs whose genotypes agree at ``share`` or more of their common sites.

    Samples meet at sites where both have a call, so the work is the number of co-occurrences; sites should be a fixed panel of some hundred.
    """
    rows = genotypes.filter(F.col(genotype).isNotNull())
    a = rows.select(F.col(site), F.col(sample).alias("a"), F.col(genotype).alias("ga"))
    b = rows.select(F.col(site), F.col(sample).alias("b"), F.col(genotype).alias("gb"))
    pairs = a.join(b, site).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("sites"), F.count_if(F.col("ga") == F.col("gb")).alias("matches"))
    return pairs.filter((F.col("sites") >= least_sites) & (F.col("matches") >= share * F.col("sites")))


def wide(rows: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A matrix of sums with the given columns, 0 where nothing is."""
    return rows.groupBy(row).pivot(column, columns).agg(F.sum(value)).fillna(0)


def long(matrix: DataFrame, row: str, column: str, value: str) -> DataFrame:
    return matrix.unpivot([row], [c for c in matrix.columns if c != row], column, value)


def shared_weights(compatible: DataFrame, fragment: str, alleles: str) -> DataFrame:
    """(allele, unique, shared, total): a fragment compatible with k alleles gives each 1 / k; unique counts those with k = 1."""
    each = compatible.select(F.size(alleles).alias("k"), F.explode(alleles).alias("allele"))
    return each.groupBy("allele").agg(F.count_if(F.col("k") == 1).alias("unique"), F.sum(F.when(F.col("k") > 1, 1 / F.col("k")).otherwise(0.0)).alias("shared"), F.sum(1 / F.col("k")).alias("total"))


def tpm(rows: DataFrame, by: list[str], gene: str, fragments: str, length: str, enriched: list[str] | Column | None = None, cap: float = 0.01, steps: int = 10) -> DataFrame:
    """The rows with ``tpm``: fragments per kb over the sample's adjusted total in millions.

    The total leaves out enriched genes, given as names or as a condition, and caps any gene at ``cap`` of it, by up to ``steps`` rounds over sums per sample.
    """
    per_kb = F.col(fragments) * 1000 / F.col(length)
    rated = rows.withColumn("__rate", per_kb)
    used = rated.filter(~(enriched if isinstance(enriched, Column) else F.col(gene).isin(enriched or [])))
    total = used.groupBy(*by).agg(F.sum("__rate").alias("__total"))
    for _ in range(steps):
        total = used.join(total, by).groupBy(*by).agg(F.sum(F.least("__rate", cap * F.col("__total"))).alias("__total"))
    return rated.join(total, by).withColumn("tpm", F.col("__rate") * 1e6 / F.col("__total")).drop("__rate", "__total")

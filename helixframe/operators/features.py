"""Summaries, feature tables and classifiers by sample."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I


def structural_burden(variants: DataFrame, genes: DataFrame, segments: DataFrame, deleted: float = 0.5) -> DataFrame:
    """(sample, sv_burden, deleted_genes, segments, unsupported): passing variants that are not inferred, genes whose least copy number is under the limit, segments, and those without support at either end."""
    a = variants.groupBy("sample").agg(F.count_if((F.col("filters") == "PASS") & (F.col("type") != "INF")).alias("sv_burden"))
    b = genes.groupBy("sample").agg(F.count_if(F.col("min_cn") < deleted).alias("deleted_genes"))
    c = segments.groupBy("sample").agg(F.count("*").alias("segments"), F.count_if((F.col("start_support") == "NONE") & (F.col("end_support") == "NONE")).alias("unsupported"))
    return a.join(b, "sample", "full_outer").join(c, "sample", "full_outer").fillna(0)


def driver_catalog(variants: DataFrame, impacts: list[str]) -> DataFrame:
    """(sample, gene, <impact> counts, biallelic, hotspot, likelihood): one row for each gene, with counts of its variants by impact, and the largest likelihood."""
    return variants.groupBy("sample", "gene").agg(*[F.count_if(F.col("impact") == i).alias(i.lower()) for i in impacts], F.bool_or("biallelic").alias("biallelic"), F.bool_or("hotspot").alias("hotspot"), F.max("likelihood").alias("likelihood"))


def panel_genes(genes: DataFrame, panel: DataFrame, ploidy: str, ratio: float = 3.0) -> DataFrame:
    """Genes (sample, gene, chromosome, male, min_cn, ploidy) of the panel's amplification genes (gene) that reach ``ratio`` times the ploidy, half of it on a male's X; the panel is an inner join."""
    limit = F.col(ploidy) * ratio * F.when(F.col("male") & (F.col("chromosome") == "X"), 0.5).otherwise(1.0)
    return genes.join(panel.select("gene").distinct(), "gene").filter(F.col("min_cn") >= limit)


def indel_context(ref: Column, alt: Column, repeats: Column, homology: Column, most: int = 5) -> Column:
    """Such as ``del.mh.bimh.2``: insertions and deletions by repeat, microhomology (deletions) or neither, with the number capped."""
    size = F.abs(F.length(alt) - F.length(ref))
    kind = F.when(F.length(alt) > F.length(ref), "ins").otherwise("del")
    capped = lambda n: F.least(n, F.lit(most)).cast("string")
    return F.when(repeats > 1, F.concat(kind, F.lit(".rep.len."), capped(size))).when((kind == "del") & (homology > 0), F.concat(kind, F.lit(".mh.bimh."), capped(homology))).otherwise(F.concat(kind, F.lit(".none.len."), capped(size)))


def mutational_loads(variants: DataFrame) -> DataFrame:
    """(sample, snv_biallelic, snv_other, indel_biallelic, indel_other): the cohort's loads that driver rates are fitted to."""
    n = lambda snv, b: F.count_if((F.col("snv") == snv) & (F.col("biallelic") == b))
    return variants.groupBy("sample").agg(n(True, True).alias("snv_biallelic"), n(True, False).alias("snv_other"), n(False, True).alias("indel_biallelic"), n(False, False).alias("indel_other"))


def driver_counts(observed: DataFrame, rates: DataFrame) -> DataFrame:
    """(gene, impact, drivers, passengers, probability) from observed counts (gene, impact, n) and selection ratios (gene, impact, ratio): of n variants n (ratio - 1) / ratio are drivers, where the ratio exceeds one."""
    both = observed.join(rates, ["gene", "impact"], "left")
    share = F.when(F.col("ratio") > 1, (F.col("ratio") - 1) / F.col("ratio")).otherwise(0.0)
    return both.select("gene", "impact", (F.col("n") * share).alias("drivers"), (F.col("n") * (1 - share)).alias("passengers"), share.alias("probability"))


def residuals(counts: DataFrame, fitted: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """(by, total, excess, unallocated, share): how far fitted counts (by, bucket, n) exceed observed ones, fall short of them, and both over the total."""
    both = counts.select(*by, bucket, F.col("n").alias("__o")).join(fitted.select(*by, bucket, F.col("n").alias("__f")), [*by, bucket], "full_outer").fillna(0, ["__o", "__f"])
    over, under = F.sum(F.greatest(F.lit(0.0), F.col("__f") - F.col("__o"))), F.sum(F.greatest(F.lit(0.0), F.col("__o") - F.col("__f")))
    return both.groupBy(*by).agg(F.sum("__o").alias("total"), over.alias("excess"), under.alias("unallocated")).withColumn("share", F.when(F.col("total") > 0, (F.col("excess") + F.col("unallocated")) / F.col("total")))


def simulated(rates: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """(sample, bucket, n): counts drawn for each sample and bucket (bucket, mean) from a Poisson distribution, by inverting it on a uniform number that depends on seed, sample and bucket alone."""
    from ..functions.stats import poisson_pmf_array

    def draw(mean: pd.Series, u: pd.Series) -> pd.Series:
        top = int(np.ceil(mean.max() + 12 * np.sqrt(mean.max() + 1))) + 1 if len(mean) else 1
        values, where = np.unique(mean.to_numpy(float), return_inverse=True)
        table = np.cumsum(poisson_pmf_array(np.arange(top)[None, :], values[:, None]), axis=1)
        return pd.Series((table[where] < u.to_numpy(float)[:, None]).sum(1))

    u = (F.xxhash64(F.lit(seed), "sample", "bucket").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)).alias("u")
    every = rates.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return every.select("sample", "bucket", F.pandas_udf(draw, "long")("mean", u).alias("n"))


def profile_similarity(samples: DataFrame, profiles: DataFrame, bucket: str) -> DataFrame:
    """(sample, profile, cosine): cosine similarity of every sample (sample, bucket, n) to every class profile (profile, bucket, n); profiles are some dozen."""
    norm = lambda df, k: df.groupBy(k).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"__{k}"))
    dot = samples.join(profiles.select("profile", bucket, F.col("n").alias("__n")), bucket).groupBy("sample", "profile").agg(F.sum(F.col("n") * F.col("__n")).alias("__d"))
    return dot.join(norm(samples, "sample"), "sample").join(norm(profiles, "profile"), "profile").select("sample", "profile", (F.col("__d") / F.col("__sample") / F.col("__profile")).alias("cosine"))


def softmax_scores(features: DataFrame, weights: DataFrame, sample: str, override: DataFrame | None = None) -> DataFrame:
    """(sample, class, probability) of long features (sample, feature, value) under a linear model (class, feature, weight; the intercept's feature is empty).

    Classes that ``override`` (sample, class) names for a sample, such as those of the other sex, get probability 0 before the rest is scaled.
    """
    classes = weights.filter("feature = ''").select("class", F.col("weight").alias("__b"))
    dot = features.join(weights.filter("feature != ''"), "feature").groupBy(sample, "class").agg(F.sum(F.col("value") * F.col("weight")).alias("__d"))
    every = features.select(sample).distinct().join(F.broadcast(classes), F.lit(True)).join(dot, [sample, "class"], "left")  # classes are some dozen
    score = F.col("__b") + F.coalesce("__d", F.lit(0.0))
    if override is not None:
        every = every.join(override.withColumn("__no", F.lit(True)), [sample, "class"], "left")
        score = F.when(F.col("__no"), F.lit(None).cast("double")).otherwise(score)
    own = Window.partitionBy(sample)
    marked = every.withColumn("__s", score)
    e = F.coalesce(F.exp(F.col("__s") - F.max("__s").over(own)), F.lit(0.0))
    return marked.withColumn("__e", e).select(sample, "class", (F.col("__e") / F.sum("__e").over(own)).alias("probability"))


def forest_scores(features: DataFrame, columns: list[str], trees: pd.DataFrame) -> DataFrame:
    """The rows of wide features with ``score``: the mean over trees of the leaf each row reaches.

    trees: (tree, node, feature, threshold, left, right, value); a node with no feature is a leaf, a value up to the threshold goes left. The model is a parameter of bounded size and goes with the function.
    """
    model = []
    for _, t in trees.sort_values("node").groupby("tree"):
        at = {n: i for i, n in enumerate(t["node"])}
        which = np.array([columns.index(f) if isinstance(f, str) and f else -1 for f in t["feature"]])
        go = lambda c: np.array([at.get(x, 0) for x in t[c]])
        model.append((which, t["threshold"].to_numpy(float), go("left"), go("right"), t["value"].to_numpy(float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = rows[columns].to_numpy(float)
            total = np.zeros(len(x))
            for which, limit, left, right, value in model:
                node = np.zeros(len(x), int)
                while True:
                    open_ = np.flatnonzero(which[node] >= 0)
                    if not len(open_):
                        break
                    n = node[open_]
                    node[open_] = np.where(x[open_, which[n]] <= limit[n], left[n], right[n])
                total += value[node]
            yield rows.assign(score=total / max(1, len(model)))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema] + ["score double"])
    return features.mapInPandas(run, schema)


def isotonic(score: Column, points: list[tuple[float, float]]) -> Column:
    """A calibrated probability: steps of a table of (score, probability), linear between them, flat beyond."""
    from ..functions.stats import interpolated

    return interpolated(score, [p[0] for p in points], [p[1] for p in points])


def long_features(table: DataFrame, sample: str, category: str, columns: list[str]) -> DataFrame:
    """(sample, category, feature, value) of a wide table, values as numbers."""
    return table.select(sample, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([sample], columns, "feature", "value").select(sample, F.lit(category).alias("category"), "feature", "value")


def coverage_summary(counts: DataFrame, by: list[str], levels: list[int]) -> DataFrame:
    """(by, mean, median, share_<level>) from a histogram (by, depth, bases): computed from sums, never from bases."""
    order = Window.partitionBy(*by).orderBy("depth")
    ran = counts.withColumns({"__sum": F.sum("bases").over(order), "__all": F.sum("bases").over(Window.partitionBy(*by))})
    share = [(F.sum(F.when(F.col("depth") >= x, F.col("bases")).otherwise(0)) / F.sum("bases")).alias(f"share_{x}") for x in levels]
    return ran.groupBy(*by).agg((F.sum(F.col("depth") * F.col("bases")) / F.sum("bases")).alias("mean"), F.min(F.when(F.col("__sum") * 2 >= F.col("__all"), F.col("depth"))).alias("median"), *share)


def report_rows(findings: DataFrame, sample: str, most: int = 5) -> DataFrame:
    """What a report shows of findings (sample, kind, name, reported, likelihood): the reported ones, and of the others up to ``most`` of each kind of the largest likelihood (ties by name)."""
    order = Window.partitionBy(sample, "kind", "reported").orderBy(F.desc("likelihood"), "name")
    return findings.withColumn("rank", F.row_number().over(order)).filter(F.col("reported") | (F.col("rank") <= most))


def virus_calls(viruses: DataFrame, species: DataFrame, blacklist: DataFrame, names: DataFrame, clonal: Column, usable: Column) -> DataFrame:
    """Viruses (sample, taxid, genus, species, integrations, covered, depth, qc) with name, interpretation, reported, likelihood and blacklisted.

    species: (species, interpretation, likelihood, integrated_least, other_least), the least covered shares of integrated and other ones, null for none. A known species is reported where no share is asked, or, in a usable sample, where it is exceeded and the
    depth exceeds the expected clonal one; never with low viral coverage. A virus both reported and blacklisted stops the query.
    """
    c = F.col
    s = species.withColumn("__known", F.lit(True))
    both = viruses.join(s, "species", "left").join(names, "taxid", "left")
    black = blacklist.select(F.col("taxid").alias("__t")).distinct()
    both = both.join(black.select(F.col("__t").alias("genus"), F.lit(True).alias("__g")), "genus", "left").join(black.select(F.col("__t").alias("species"), F.lit(True).alias("__s")), "species", "left")
    least = F.when(c("integrations") >= 1, c("integrated_least")).otherwise(c("other_least"))
    deep = least.isNull() | (usable & (c("covered") > least) & (c("depth") > clonal))
    reported = F.coalesce(c("__known") & deep & (c("qc") != "LOW_VIRAL_COVERAGE"), F.lit(False))
    blacklisted = c("__g").isNotNull() | c("__s").isNotNull()
    checked = F.when(reported & blacklisted, F.raise_error(F.concat(F.lit("reported and blacklisted: "), c("taxid").cast("string")))).otherwise(reported)
    return both.withColumns({"reported": checked, "blacklisted": blacklisted, "likelihood": F.when(reported, c("likelihood")).otherwise("UNKNOWN"), "expected_clonal": F.when(usable, clonal)}).drop("__known", "__g", "__s", "integrated_least", "other_least")


def cluster_drivers(drivers: DataFrame, clusters: DataFrame, bin_size: int) -> DataFrame:
    """(gene, kind, cluster): for each driver (gene, kind, chromosome, start, end) the cluster whose breakend (cluster, chromosome, position) lies nearest to the gene among those within 1 Mb, ties by cluster; null without one."""
    b = clusters.select("cluster", "chromosome", F.col("position").alias("__a"), F.col("position").alias("__b"))
    hit = I.range_join(drivers, b, ["chromosome"], ("start", "end"), ("__a", "__b"), bin_size, slack=1_000_000 if bin_size >= 100_000 else 4 * bin_size)
    gap = F.greatest(F.lit(0), F.col("start") - F.col("__a"), F.col("__a") - F.col("end"))
    best = hit.groupBy("gene", "kind").agg(F.min_by("cluster", F.struct(gap.alias("g"), "cluster")).alias("cluster"))
    return drivers.select("gene", "kind").distinct().join(best, ["gene", "kind"], "left")


def variant_frequency(variants: DataFrame, keys: list[str], sample: str, cohort: int) -> DataFrame:
    """(keys, samples, share) of variants over a cohort of the given size."""
    return variants.groupBy(*keys).agg(F.count_distinct(sample).alias("samples")).withColumn("share", F.col("samples") / cohort)


def poisson_limit(mean: float, confidence: float = 0.95) -> int:
    """The least count that a mean exceeds with no more than the rest of the confidence."""
    k, p, total = 0, math.exp(-mean), math.exp(-mean)
    while total < confidence:
        k += 1
        p *= mean / k
        total += p
    return k

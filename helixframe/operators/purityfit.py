"""What surrounds the purity fit: usable regions, expected allele frequencies, peaks, readjustment, detection of odd samples."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import binomial_cdf
from . import intervals as I

#: Largest tumor ratio of a region that is fitted; ambiguous frequency; shares and cutoffs of aneuploid regions; chimerism.
MOST_RATIO, AMBIGUOUS = 3.0, 0.535
ANEUPLOID_CUTOFF, ANEUPLOID_SHARE, HIGH_CUTOFF, HIGH_SHARE, HIGH_LEAST = 0.57, 0.008, 0.7, 0.003, 5
CHIMERIC, CHIMERIC_LEAST = 0.08, 2
#: Fixed values of the readjustment: copy numbers, minor allele, probability, variants, ratio, outliers at low and other purity, low purity, step.
READJUST = {"cn": (1.8, 2.2), "minor": 0.5, "probability": 0.005, "variants": 5, "ratio": 4.0, "outliers": (10, 20), "low": 0.2, "step": 0.005}
#: Fixed values of the search for peaks under the noise floor: start, end, ratio and first step; share of a binomial that captures; least points; frequency tolerance.
PEAKS = {"start": 0.005, "end": 0.37, "ratio": 1.05, "first": 0.001, "low": 0.16, "high": 0.84, "points": 15, "tolerance": 0.15}


def usable_region(baf_count: Column, ratio: Column, status: Column, diploid_chromosome: Column) -> Column:
    """Whether a region takes part in the fit."""
    return (baf_count > 0) & (ratio >= 0) & (status == "DIPLOID") & (ratio <= MOST_RATIO) & diploid_chromosome


def usable_site(depth: Column, low: Column, frequency: Column, least: int, most_low: float = 0.05) -> Column:
    """Whether a heterozygous site's tumor evidence is kept: deep enough, few bases of low quality, and a number."""
    return (depth >= least) & (low <= most_low * depth) & frequency.isNotNull() & ~F.isnan(frequency)


def expected_baf(depth: int, share: float = 0.8) -> float:
    """Frequency that a balanced region shows by chance alone at an average depth: the mean over depths from half to one and a half of it of the binomial's quantile, at least the ambiguous one."""
    total = 0.0
    for n in range(depth // 2, depth * 3 // 2):
        p, cumulative, k = 0.5**n, 0.5**n, 0
        while cumulative < share:
            p *= (n - k) / (k + 1)
            k += 1
            cumulative += p
        total += k / n
    return max(total / (depth * 3 // 2 - depth // 2), AMBIGUOUS)


def with_expected_baf(rows: DataFrame, depth: str, name: str = "baf") -> DataFrame:
    """The rows with ``expected_baf`` of their whole depth, each distinct depth computed once, in tasks; null for null and for depths without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([expected_baf(d) if d and d > 1 else None for d in batch.column(0).to_pylist()], pa.float64())], ["__depth", name])

    known = rows.select(F.col(depth).cast("long").alias("__depth")).distinct().mapInArrow(run, f"__depth long, `{name}` double")
    return rows.join(known, F.col(depth).cast("long").eqNullSafe(F.col("__depth")), "left").drop("__depth")


def collated(tumor: DataFrame | None, reference: DataFrame | None, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, tumor_<value>, reference_<value>): both sides' windows by position. A side that is absent as a whole gives -1; positions of one side alone stop the query."""
    rename = lambda df, side: df.select(*keys, *[F.col(v).alias(f"{side}_{v}") for v in values], F.lit(True).alias(f"__{side}"))
    if tumor is None or reference is None:
        side, other, df = ("tumor", "reference", tumor) if reference is None else ("reference", "tumor", reference)
        return df.select(*keys, *[(F.col(v) if s == side else F.lit(-1.0)).alias(f"{s}_{v}") for s in ("tumor", "reference") for v in values])
    both = rename(tumor, "tumor").join(rename(reference, "reference"), keys, "full_outer")
    ok = F.col("__tumor").isNotNull() & F.col("__reference").isNotNull()
    check = lambda c: F.when(ok, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("a position of one side only: "), F.concat_ws(" ", *keys))))
    return both.select(*keys, *[check(f"{s}_{v}").alias(f"{s}_{v}") for s in ("tumor", "reference") for v in values])


def extended_support(regions: DataFrame, by: list[str]) -> DataFrame:
    """Regions (by, start, support, status, min_start) with ``extended``: a diploid one without support of its own reaches back over the others that are not diploid, up to the first with support.

    Regions before it are counted off by running groups: a group begins behind every diploid or supported region.
    """
    order = Window.partitionBy(*by).orderBy("start")
    c = F.col
    stops = (c("status") == "DIPLOID") | (c("support") != "NONE")
    group = F.sum(F.when(F.lag(stops).over(order), 1).otherwise(0)).over(order)
    marked = regions.withColumns({"__stop": stops, "__g": group})
    # Regions that may be reached: those of the own group, and the supported one that ended the group before, if it isn't diploid.
    own = Window.partitionBy(*by, "__g").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("start").over(own)
    ended = F.lag(F.when((c("status") != "DIPLOID") & (c("support") != "NONE"), c("start"))).over(order)
    ends = marked.withColumn("__ended", ended).withColumn("__start_of", F.first("__ended").over(Window.partitionBy(*by, "__g").orderBy("start")))
    least = F.least("__start_of", "__first")  # of what is there
    takes = (c("support") == "NONE") & (c("status") == "DIPLOID")
    return ends.withColumn("__first", first).withColumn("extended", F.when(takes & least.isNotNull(), F.least(c("min_start"), least)).otherwise(c("min_start"))).drop("__stop", "__g", "__ended", "__start_of", "__first")


def aneuploidy(regions: DataFrame, by: list[str]) -> DataFrame:
    """(by, share, aneuploid, implied_purity) from regions (by, baf, count): aneuploid if enough points lie in regions over the cutoff, or any region with enough points is far over it.

    implied_purity: 2 baf - 1 of the region in which the points, in order of baf, pass all but the highest ``HIGH_SHARE``, or of the last valid one before it.
    """
    c = F.col
    high = (c("baf") >= ANEUPLOID_CUTOFF) & (c("count") >= 1)
    order = Window.partitionBy(*by).orderBy("baf", "count")
    ran = regions.withColumns({"__sum": F.sum("count").over(order), "__all": F.sum("count").over(Window.partitionBy(*by))})
    valid = (c("count") >= HIGH_LEAST) & (c("baf") >= ANEUPLOID_CUTOFF)
    past = c("__sum") >= c("__all") * (1 - HIGH_SHARE)
    ran = ran.withColumn("__pass", F.row_number().over(Window.partitionBy(*by, past).orderBy("baf", "count")))
    usable = valid & (~past | (c("__pass") == 1))
    far = (c("baf") >= HIGH_CUTOFF) & (c("count") >= F.greatest(F.lit(HIGH_LEAST), c("__all") * HIGH_SHARE))
    out = ran.groupBy(*by).agg((F.sum(F.when(high, c("count")).otherwise(0)) / F.sum("count")).alias("share"), F.bool_or(far).alias("far"), F.max_by(F.when(usable, 2 * c("baf") - 1), F.when(usable, F.struct("baf", "count"))).alias("implied_purity"))
    return out.select(*by, "share", ((c("share") >= ANEUPLOID_SHARE) | c("far")).alias("aneuploid"), "implied_purity")


def chimerism(regions: DataFrame, points: DataFrame, by: list[str], bin_size: int) -> DataFrame:
    """(sample, spread, chimeric): the mean over diploid regions (by, sample, start, end) of the spread of the allele frequencies in them (by, position, baf), weighted by their number; under two points a region has none."""
    hit = I.range_join(points.withColumn("__p", F.col("position")), regions, by, ("position", "__p"), ("start", "end"), bin_size)
    each = hit.groupBy("sample", *by, "start").agg(F.stddev_samp("baf").alias("s"), F.count("*").alias("n")).filter(F.col("n") >= CHIMERIC_LEAST)
    return each.groupBy("sample").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("spread")).withColumn("chimeric", F.col("spread") > CHIMERIC)


def loh_fraction_af(sites: DataFrame, by: list[str], region: str, most: float = 0.5) -> DataFrame:
    """(by, regions, sites, support, median_af) of sites (by, region, support, depth) in regions of lost heterozygosity: each region's support over depth stands for all its sites, regions at ``most`` or more are left out, and the median is over sites."""
    each = sites.groupBy(*by, region).agg(F.sum("support").alias("__s"), F.sum("depth").alias("__d"), F.count("*").alias("__n")).withColumn("af", F.col("__s") / F.col("__d")).filter(F.col("af") < most)
    order = Window.partitionBy(*by).orderBy("af", region)
    ran = each.withColumns({"__sum": F.sum("__n").over(order), "__all": F.sum("__n").over(Window.partitionBy(*by))})
    middle = F.min(F.when(F.col("__sum") > F.floor(F.col("__all") / 2), F.col("af")))  # the site at place floor(n / 2), from 0
    return ran.groupBy(*by).agg(F.count("*").alias("regions"), F.sum("__n").alias("sites"), F.sum("__s").alias("support"), middle.alias("median_af"))


def peak_levels() -> list[float]:
    """The levels at which a peak is looked for; steps widen by a fixed ratio."""
    out, level, step = [], PEAKS["start"], PEAKS["first"]
    while level < PEAKS["end"]:
        out.append(round(level, 9))
        level, step = level + step, step * PEAKS["ratio"]
    return out


def noise_peaks(evidence: DataFrame, levels: list[float]) -> DataFrame:
    """(level, tested, homozygous, heterozygous, score): points (n, k) whose symmetric frequency lies in the middle of a binomial at the level, or at half of it, by the normal approximation of its bounds.

    Points are counted by (n, k) first; the levels are some hundred rows and broadcast. A point in both bands belongs to the nearer one. Levels under ``points`` captured are left out; score is the captured share of what is tested.
    """
    spark = evidence.sparkSession
    grid = spark.createDataFrame([(x,) for x in levels], "level double")
    k = F.least(F.col("k"), F.col("n") - F.col("k"))
    shape = evidence.groupBy(F.col("n").cast("double").alias("n"), k.cast("double").alias("k")).agg(F.count("*").alias("c"))
    af, n, level = F.col("k") / F.col("n"), F.col("n"), F.col("level")
    inside = lambda p: F.abs(af - p) <= F.sqrt(p * (1 - p) / n)  # noqa: E731  # about the bounds 0.16 and 0.84
    hom, het = inside(level), inside(level / 2)
    own = F.when(hom & het, F.when(af > 0.75 * level, "hom").otherwise("het")).when(hom, "hom").when(het, "het")
    met = shape.filter("n > 0").join(F.broadcast(grid), F.lit(True)).withColumn("__b", own)
    tested = n * level / 2 >= 2
    out = met.filter(tested).groupBy("level").agg(F.sum("c").alias("tested"), F.sum(F.when(F.col("__b") == "hom", F.col("c")).otherwise(0)).alias("homozygous"), F.sum(F.when(F.col("__b") == "het", F.col("c")).otherwise(0)).alias("heterozygous"))
    both = F.col("homozygous") + F.col("heterozygous")
    return out.filter(both >= PEAKS["points"]).withColumn("score", both / F.col("tested"))


def local_maxima(rows: DataFrame, level: str, score: str) -> DataFrame:
    """Rows whose score is over that of the level before and not under that of the next; a grid's rows, some hundred."""
    order = Window.orderBy(level)
    return rows.withColumns({"__a": F.lag(score).over(order), "__b": F.lead(score).over(order)}).filter((F.col("__a").isNull() | (F.col(score) > F.col("__a"))) & (F.col("__b").isNull() | (F.col(score) >= F.col("__b")))).drop("__a", "__b")


def frequencies_agree(points: DataFrame, by: list[str], expected: Column, tolerance: float = 0.15) -> DataFrame:
    """(by, low, high, agrees): mean population frequency of a peak's points (by, vaf, population) below and above one half, and whether both are there and near the expected one and one minus it."""
    out = points.groupBy(*by).agg(F.avg(F.when(F.col("vaf") < 0.5, F.col("population"))).alias("low"), F.avg(F.when(F.col("vaf") >= 0.5, F.col("population"))).alias("high"))
    near = (F.abs(F.col("low") - expected) <= tolerance) & (F.abs(F.col("high") - (1 - expected)) <= tolerance)
    return out.withColumn("agrees", F.coalesce(near, F.lit(False)))


def readjusted_purity(variants: DataFrame, standard: float) -> float | None:
    """The lowest purity at which variants (n, k) show no more outliers than expected, from ``standard`` on in fixed steps; null if there are too few variants or outliers.

    Candidates are counted by (n, k), so each tested purity is one aggregation over distinct pairs; all of them are one query over a broadcast grid.
    """
    rule = READJUST
    shape = variants.groupBy(F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k")).agg(F.count("*").alias("c"))
    first = shape.agg(F.sum("c").alias("c"), F.max(F.col("k") / F.col("n")).alias("m")).first()
    if (first.c or 0) < rule["variants"]:
        return None
    top = min(first.m * 2, 1.0)
    steps = max(1, math.ceil((top - standard) / rule["step"] - 1e-9))
    grid = variants.sparkSession.createDataFrame([(round(standard + rule["step"] * i, 9),) for i in range(steps)], "purity double")
    vaf = F.col("purity") / 2
    tail = F.when(F.col("k") > F.col("n") * vaf, 1 - binomial_cdf((F.col("k") - 1).cast("double"), F.col("n").cast("double"), vaf)).otherwise(1.0)
    met = shape.join(F.broadcast(grid), F.lit(True)).withColumn("p", tail)
    order = Window.partitionBy("purity").orderBy("p")
    ran = met.withColumn("__sum", F.sum("c").over(order))
    limit = ran.groupBy("purity").agg(F.greatest(F.min(F.when(F.col("__sum") >= rule["variants"], F.col("p"))), F.lit(rule["probability"])).alias("limit"))
    share = F.col("k") / F.col("n")
    counted = met.join(F.broadcast(limit), "purity").groupBy("purity", "limit").agg(
        F.sum(F.when(share >= vaf, F.col("c")).otherwise(0)).alias("over"), F.sum(F.when(F.col("p") <= F.col("limit"), F.col("c")).otherwise(0)).alias("low"), F.sum(F.when(F.col("p") >= F.col("limit"), F.col("c")).otherwise(0)).alias("high"),
    )
    rows = sorted(counted.withColumn("expected", F.col("over") * F.col("limit") / 0.5).collect(), key=lambda r: r.purity)  # a row for each purity of the grid
    least = rule["outliers"][0 if standard >= rule["low"] else 1]
    if rows[0].high < max(rows[0].expected * rule["ratio"], least):
        return None
    return next((r.purity for r in rows if r.low <= r.expected), None)


def low_counts(variants: DataFrame, by: list[str], least: int = 4, depth: float = 50.0) -> DataFrame:
    """(by, depth, one, more, usable, median_tf): sites with one and with more fragments, the depth weighted by copies, whether the model of low counts may be used, and the median implied tumor fraction, capped at 2.

    variants: (by, support, depth, copies (of the segment), variant_copies).
    """
    c = F.col
    af = c("support") / c("depth")
    rest = c("variant_copies") + 2 * af - c("copies") * af
    tf = F.when(rest > 0, F.least(F.lit(2.0), 2 * af / rest)).otherwise(2.0)
    out = variants.filter("depth > 0").groupBy(*by).agg((F.sum(c("depth") * c("depth") / c("copies")) / F.sum(c("depth") / c("copies"))).alias("depth"), F.count_if(c("support") == 1).alias("one"), F.count_if(c("support") >= 2).alias("more"), F.count("*").alias("n"), F.percentile(tf, 0.5).alias("median_tf"))
    return out.select(*by, "depth", "one", "more", ((c("depth") < depth) & (c("more") >= F.greatest(F.lit(float(least)), 0.005 * c("n")))).alias("usable"), "median_tf")


def copy_levels(windows: DataFrame, segments: DataFrame, by: list[str], bin_size: int, near: float = 0.2, most: int = 6) -> DataFrame:
    """(sample, level, windows, median) of depth windows (by, sample, position, ratio) in segments (by, start, end, cn) of nearly whole copy number 0 to ``most``."""
    level = F.floor(F.col("cn") + 0.5).cast("int")
    whole = segments.filter((F.abs(F.col("cn") - level) <= near) & (level <= most) & (level >= 0)).select(*by, F.col("start").alias("__a"), F.col("end").alias("__b"), level.alias("level"))
    hit = I.range_join(windows.withColumn("__p", F.col("position")), whole, by, ("position", "__p"), ("__a", "__b"), bin_size)
    return hit.groupBy("sample", "level").agg(F.count("*").alias("windows"), F.percentile("ratio", 0.5).alias("median"))


def enrichment(panel: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, samples, enrichment) from panel samples' windows (keys, sample, ratio): the median over samples of the ratio to the sample's own median, null where that is under 0.1 or absent in half of them."""
    mid = panel.filter("ratio > 0").groupBy("sample").agg(F.percentile("ratio", 0.5).alias("__m"))
    each = panel.join(mid, "sample").withColumn("__r", F.col("ratio") / F.col("__m"))
    n = F.count("*")
    median = F.percentile("__r", 0.5)
    return each.groupBy(*keys).agg(n.alias("samples"), F.when((median >= 0.1) & (F.count_if(F.col("ratio") > 0) * 2 > n), median).alias("enrichment"))


def subclonal_peaks(variants: DataFrame, by: list[str], width: float = 0.01, fine: float = 0.05, most: float = 10.0, rounds: int = 10, unexplained: float = 0.01) -> DataFrame:
    """(by, round, peak, weight, subclonal): peaks of variant copy numbers (by, copies, depth, purity_copies) one after another, each modelled as a binomial spread about it and taken off.

    A sample's variants are first counted into bins of ``width``, so the scan of one sample holds a histogram and not its variants. A peak is the bin about which most weight lies within ``fine``; its model spreads the weight within ``fine`` of it over all
    bins by a normal approximation of the binomial at the mean depth there. It ends when less than ``unexplained`` of the weight is left.
    """
    bins = variants.filter((F.col("copies") >= 0) & (F.col("copies") <= most)).groupBy(*by, F.floor(F.col("copies") / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("depth").alias("depth"), F.avg("purity_copies").alias("total"))
    kinds = ", ".join(f"{k} {variants.schema[k].dataType.simpleString()}" for k in by)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        size = int(round(most / width)) + 1
        left, depth, total = np.zeros(size), np.zeros(size), np.zeros(size)
        at = group["bin"].to_numpy()
        left[at], depth[at], total[at] = group["n"], group["depth"], group["total"]
        x = (np.arange(size) + 0.5) * width
        start, reach = left.sum(), int(round(fine / width))
        out = []
        for k in range(rounds):
            sums = np.convolve(np.maximum(left, 0), np.ones(2 * reach + 1), "same")
            top = int(np.argmax(sums))
            near = slice(max(0, top - reach), top + reach + 1)
            weight = np.maximum(left[near], 0)
            if weight.sum() <= 0:
                break
            mean, copies = np.average(depth[near], weights=weight), np.average(total[near], weights=weight)
            share = min(0.999, max(1e-3, x[top] / copies)) if copies else 0.5
            spread = max(width, copies * math.sqrt(share * (1 - share) / max(1.0, mean)))
            model = np.exp(-0.5 * ((x - x[top]) / spread) ** 2)
            model *= weight.sum() / model[near].sum()
            taken = np.minimum(model, np.maximum(left, 0))
            left = left - taken
            out.append((k, float(x[top]), float(taken.sum()), bool(x[top] < 0.85)))
            if np.maximum(left, 0).sum() < unexplained * start:
                break
        got = pd.DataFrame(out, columns=["round", "peak", "weight", "subclonal"])
        for k in by:
            got[k] = group[k].iloc[0]
        return got[[*by, "round", "peak", "weight", "subclonal"]]

    return bins.groupBy(*by).applyInPandas(run, f"{kinds}, round int, peak double, weight double, subclonal boolean")

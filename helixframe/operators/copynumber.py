"""Copy-number segments: genes, arms, losses, drivers, breakpoints on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I


def gene_copy_number(exons: DataFrame, segments: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """(gene, min, max, min_minor, min_start, min_end, min_regions, regions) over the segments that a gene's exons overlap.

    exons: (gene, chromosome, exon_start, exon_end); segments: (chromosome, start, end, cn, minor). The minimum region begins at the first segment
    with the least copy number; runs of further segments of that number that touch extend it, and others are counted.
    """
    hit = I.range_join(exons, segments, ["chromosome"], ("exon_start", "exon_end"), ("start", "end"), bin_size).select("gene", "chromosome", "start", "end", "cn", "minor").distinct()
    low = hit.groupBy("gene").agg(F.min("cn").alias("min"), F.max("cn").alias("max"), F.min("minor").alias("min_minor"), F.count("*").alias("regions"))
    least = hit.join(low.select("gene", "min"), "gene").filter("cn = min")
    order = Window.partitionBy("gene").orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(order) > 1, 1).otherwise(0)
    runs = least.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order))
    spans = runs.groupBy("gene").agg(F.min("start").alias("min_start"), F.max(F.when(F.col("__run") == 0, F.col("end"))).alias("min_end"), (F.max("__run") + 1).alias("min_regions"))
    return low.join(spans, "gene")


def arm_copy_number(segments: DataFrame, arm: Column) -> DataFrame:
    """(chromosome, arm, mean, median, min, max): mean weighted by length; a segment belongs to the arm of its start."""
    length = F.col("end") - F.col("start") + 1
    return segments.withColumn("arm", arm).groupBy("chromosome", "arm").agg((F.sum(F.col("cn") * length) / F.sum(length)).alias("mean"), F.percentile("cn", 0.5).alias("median"), F.min("cn").alias("min"), F.max("cn").alias("max"))


def loss_events(segments: DataFrame, by: list[str], start: str, end: str, minor: str, limit: float = 0.5, insert: int = 1000) -> DataFrame:
    """(by, start, end, n): runs of segments whose minor copy number is below the limit, over other segments of ``insert`` bases at most."""
    lost = segments.filter(F.col(minor) < limit)
    return I.merged(lost, by, start, end, insert)


def loss_fraction(segments: DataFrame, by: list[str], start: str, end: str, minor: str, limit: float = 0.5) -> DataFrame:
    """(by, fraction) of bases lost."""
    length = F.col(end) - F.col(start) + 1
    return segments.groupBy(*by).agg((F.sum(F.when(F.col(minor) < limit, length).otherwise(0)) / F.sum(length)).alias("fraction"))


def driver_call(minimum: Column, minor: Column, ploidy: Column, male_x: Column, supported: Column, warned: Column, amplified: float = 3.0, deleted: float = 0.5, het: float = 0.6, loh: float = 0.5) -> Column:
    """AMP, DEL, HET_DEL, LOH or null, in this order. A male X halves the limit of an amplification; warned samples need support for a deletion."""
    amp = minimum >= ploidy * amplified * F.when(male_x, 0.5).otherwise(1.0)
    return (
        F.when(amp, "AMP").when((minimum < deleted) & (~warned | supported), "DEL").when(~male_x & (minimum >= deleted) & (minimum / ploidy < het), "HET_DEL").when(~male_x & (minor < loh), "LOH")
    )


def driver_likelihood(variants: DataFrame, rates: DataFrame) -> DataFrame:
    """(sample, gene, method, likelihood) of variants (sample, gene, hotspot, inframe, biallelic, splice_region) with dN/dS rates (gene, drivers, passengers).

    Splice-region variants alone give nothing; a hotspot gives 1, then biallelic or inframe ones 1 by their method; others the probability from the rates: for two variants
    the passengers' chance is squared.
    """
    found = variants.groupBy("sample", "gene").agg(F.max("hotspot").alias("h"), F.max(F.col("inframe") | F.col("biallelic")).alias("b"), F.count_if(~F.col("splice_region")).alias("n")).filter("n > 0")
    p = 1 - F.exp(-F.col("passengers"))
    p = F.when(F.col("n") >= 2, p * p).otherwise(p)
    d = F.col("drivers") / (F.col("drivers") + p * (1 - F.col("drivers")))
    joined = found.join(rates, "gene", "left")
    method = F.when(F.col("h"), "HOTSPOT").when(F.col("b"), "BIALLELIC_INFRAME").otherwise("DNDS")
    return joined.select("sample", "gene", method.alias("method"), F.when(F.col("h") | F.col("b"), 1.0).otherwise(F.coalesce(d, F.lit(0.0))).alias("likelihood"))


def sides(breakends: DataFrame, segments: DataFrame) -> DataFrame:
    """Breakends (id, chromosome, position) with the copy number of the segment that ends before and of the one that starts there, null where none."""
    left = segments.select("chromosome", (F.col("end") + 1).alias("position"), F.col("cn").alias("left_cn"))
    right = segments.select("chromosome", F.col("start").alias("position"), F.col("cn").alias("right_cn"))
    return breakends.join(left, ["chromosome", "position"], "left").join(right, ["chromosome", "position"], "left")


def consanguinity(runs: DataFrame, sample: str, chromosome: str, length: str, genome: float = 2.88e9, least: int = 3_000_000, total: int = 10_000_000) -> DataFrame:
    """(sample, proportion, upd): share of the genome in long runs, and the chromosome that alone carries enough of them, else null."""
    big = runs.filter(F.col(length) > least).groupBy(sample).agg((F.sum(length) / genome).alias("proportion"))
    alone = runs.filter(F.col(length) >= least).groupBy(sample).agg(F.count_distinct(chromosome).alias("n"), F.min(chromosome).alias("upd"), F.sum(length).alias("t"))
    return runs.select(sample).distinct().join(big, sample, "left").join(alone.filter((F.col("n") == 1) & (F.col("t") >= total)).select(sample, "upd"), sample, "left").fillna(0.0, ["proportion"])


def lifted(positions: DataFrame, chain: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """Positions (chromosome, position, ...) with lifted_chromosome and lifted_position by mapping segments (chromosome, start, end, to_chromosome, to_start, reverse); unmapped rows are null."""
    keyed = positions.withColumn("__p", F.col("position"))
    found = I.range_join(keyed, chain, ["chromosome"], ("position", "__p"), ("start", "end"), bin_size)
    step = F.col("position") - F.col("start")
    to = F.when(F.col("reverse"), F.col("to_start") + F.col("end") - F.col("start") - step).otherwise(F.col("to_start") + step)
    lifted = found.select(*positions.columns, F.col("to_chromosome").alias("lifted_chromosome"), to.alias("lifted_position")).dropDuplicates(positions.columns)
    return positions.distinct().join(lifted, positions.columns, "left")

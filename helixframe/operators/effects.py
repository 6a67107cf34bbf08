"""Impacts of variants, roll-ups of targets, and detection limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import poisson_cdf
from . import intervals as I

#: Fixed order of effects, worst first.
EFFECTS = ["stop_gained", "frameshift", "splice_acceptor", "splice_donor", "start_lost", "stop_lost", "missense", "inframe_deletion", "inframe_insertion", "splice_region", "synonymous", "five_prime_utr", "three_prime_utr", "intronic", "upstream_gene", "non_coding_transcript"]


def severity(effect: Column) -> Column:
    """Place in the order of effects, 0 the worst; unknown effects come last."""
    table = F.create_map(*[F.lit(x) for i, e in enumerate(EFFECTS) for x in (e, i)])
    return F.coalesce(F.try_element_at(table, effect), F.lit(len(EFFECTS)))


def impact_summary(impacts: DataFrame, variant: list[str]) -> DataFrame:
    """(variant, worst_effect, worst_gene, canonical_effect, genes) from impacts (variant, gene, transcript, canonical, effect); ties by gene, then transcript."""
    order = F.struct(severity(F.col("effect")).alias("s"), F.col("gene"), F.col("transcript"))
    return impacts.groupBy(*variant).agg(
        F.min_by("effect", order).alias("worst_effect"), F.min_by("gene", order).alias("worst_gene"),
        F.min_by(F.when(F.col("canonical"), F.col("effect")), F.when(F.col("canonical"), order)).alias("canonical_effect"), F.count_distinct("gene").alias("genes"),
    )


def target_copy_number(targets: DataFrame, windows: DataFrame, segments: DataFrame, bin_size: int) -> DataFrame:
    """(target, windows, mean_depth, mean_cn): what depth windows (chromosome, position, depth) and segments (chromosome, start, end, cn) say about each target (target, chromosome, a, b)."""
    w = windows.withColumn("__p", F.col("position"))
    points = I.range_join(w, targets, ["chromosome"], ("position", "__p"), ("a", "b"), bin_size).groupBy("target").agg(F.count("*").alias("windows"), F.avg("depth").alias("mean_depth"))
    hit = I.range_join(targets, segments, ["chromosome"], ("a", "b"), ("start", "end"), bin_size)
    part = F.least("b", "end") - F.greatest("a", "start") + 1
    cn = hit.groupBy("target").agg((F.sum(F.col("cn") * part) / F.sum(part)).alias("mean_cn"))
    return targets.select("target").join(points, "target", "left").join(cn, "target", "left").fillna(0, ["windows"])


def germline_events(regions: DataFrame, segments: DataFrame, genes: DataFrame, bin_size: int) -> DataFrame:
    """(gene, status, cn) of germline regions (chromosome, start, end, status) with the copy number of the segment that holds their start, for overlapping genes (gene, chromosome, a, b)."""
    s = segments.select("chromosome", F.col("start").alias("__s"), F.col("end").alias("__e"), "cn")
    keyed = regions.withColumn("__p", F.col("start"))
    placed = I.range_join(keyed, s, ["chromosome"], ("start", "__p"), ("__s", "__e"), bin_size).select("chromosome", "start", "end", "status", "cn")
    return I.range_join(placed, genes, ["chromosome"], ("start", "end"), ("a", "b"), bin_size).select("gene", "status", "cn").distinct()


def detection(samples: DataFrame, support: Column, expected: Column, limit: float = 0.01) -> DataFrame:
    """The samples with ``p`` (chance of at least the support under the expected noise) and ``detected``."""
    out = samples.withColumn("p", 1 - poisson_cdf((support - 1).cast("double"), expected.cast("double")))
    return out.withColumn("detected", F.col("p") < limit)

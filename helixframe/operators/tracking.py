"""Variants that are followed in later samples, their nearness to hotspots, and how well probes tell their target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals as I

#: Germline frequency and base quality from which a variant is germline, repeat count, mappability, subclonal likelihood with the copies under which it counts, quality for each allele fragment, distance from reads' ends in read lengths.
GERMLINE_AF, GERMLINE_QUALITY, REPEATS, MAPPABLE, SUBCLONAL, SUBCLONAL_COPIES, QUALITY_EACH, EDGE = 0.01, 30, 3, 1.0, 0.5, 0.7, 18, 0.06
#: Fixed value: bases around a hotspot that are near it.
HOTSPOT_DISTANCE = 5


def tracked_filters(variants: DataFrame, least_gc: float = 0.0) -> DataFrame:
    """The variants with ``reasons``, an array in the order of the rules, why a variant is not used to estimate tumor fractions: of the variant itself, and of the sample's evidence where it has allele fragments.

    variants: germline_af, germline_quality, near_indel, passed, repeat_count, alt_repeat_count, is_snv, mappability, low_confidence, subclonal, copies, gc, allele_fragments, quality_sum, edge_distance. Null germline
    values, mappability, gc and edge_distance mean that nothing is known, and filter nothing; least_gc 0 lets every gc through.
    """
    c = F.col
    none = lambda x: F.coalesce(x, F.lit(False))
    seen = c("allele_fragments") > 0
    rules = [
        ("GERMLINE_AF", (c("germline_af") >= GERMLINE_AF) & (c("germline_quality") >= GERMLINE_QUALITY)), ("NEARBY_INDEL", c("near_indel")), ("NO_PASS", ~c("passed")), ("REPEAT_COUNT", F.greatest("repeat_count", "alt_repeat_count") > REPEATS),
        ("NON_SNV", ~c("is_snv")), ("MAPPABILITY", c("mappability") < MAPPABLE), ("LOW_CONFIDENCE", c("low_confidence")), ("SUBCLONAL", (c("subclonal") > SUBCLONAL) & (c("copies") < SUBCLONAL_COPIES)), ("GC_RATIO", F.lit(least_gc > 0) & (c("gc") < least_gc)),
        ("LOW_QUAL_PER_AD", seen & (c("quality_sum") / c("allele_fragments") <= QUALITY_EACH)), ("AVG_EDGE_DIST", seen & (c("edge_distance") >= 0) & (c("edge_distance") < EDGE)),
    ]
    return variants.withColumn("reasons", F.array_compact(F.array(*[F.when(none(rule), name) for name, rule in rules])))


def hotspot_flags(variants: DataFrame, hotspots: DataFrame, distance: int = HOTSPOT_DISTANCE, bin_size: int = 1000) -> DataFrame:
    """(id, hotspot): HOTSPOT where a variant (id, chromosome, position, ref, alt) is one of the hotspots (chromosome, position, ref, alt), NEAR_HOTSPOT where the bases of both, each with ``distance`` more behind, overlap, else NONE."""
    reach = lambda df: F.col("position") + F.length("ref") - 1 + distance
    v = variants.withColumn("__e", reach(variants))
    h = hotspots.select("chromosome", F.col("position").alias("__a"), reach(hotspots).alias("__b"), F.col("ref").alias("__r"), F.col("alt").alias("__t"))
    same = (F.col("position") == F.col("__a")) & (F.col("ref") == F.col("__r")) & (F.col("alt") == F.col("__t"))
    met = I.range_join(v, h, ["chromosome"], ("position", "__e"), ("__a", "__b"), bin_size).groupBy("id").agg(F.bool_or(same).alias("__same"))
    return variants.select("id").distinct().join(met, "id", "left").select("id", F.when(F.col("__same"), "HOTSPOT").when(F.col("__same").isNotNull(), "NEAR_HOTSPOT").otherwise("NONE").alias("hotspot"))


def probe_quality(alignments: DataFrame, least: int, offset: int) -> DataFrame:
    """(probe, quality, risk, off_targets, score_sum) from the scores of a probe's alignments (probe, score): the best one is its target; others of ``least`` or more are a risk of their score less least, plus ``offset`` each.

    Quality is 1 over 1 and the risk in units of the target's own; about the share of exact matches that are the target.
    """
    best = alignments.groupBy("probe").agg(F.max("score").alias("target"), F.count_if(F.col("score") >= least).alias("many"), F.coalesce(F.sum(F.when(F.col("score") >= least, F.col("score"))), F.lit(0)).alias("total"))
    own = F.when(F.col("target") >= least, 1).otherwise(0)
    count = (F.col("many") - own).cast("long")
    total = (F.col("total") - own * F.col("target")).cast("long")
    risk = total - count * (least - offset)
    return best.select("probe", (1 / (1 + F.try_divide(risk.cast("double"), (F.col("target") - least + offset).cast("double")))).alias("quality"), risk.alias("risk"), count.alias("off_targets"), total.alias("score_sum"))

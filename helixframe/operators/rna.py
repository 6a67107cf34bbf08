"""Transcript-level operators: fusions, splice junctions, retained introns, expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as I

#: By tier, least fragments, least allele frequency, least anchor, largest cohort frequency. A known pair needs 2 fragments at splice sites and 4 elsewhere; with one known gene 5 cohort samples are allowed.
FUSION_TIERS = {"KNOWN": (2, 0.0, 0, None), "SPLICE_SPLICE": (2, 0.002, 20, 2), "SPLICE_CANONICAL": (3, 0.005, 20, 2), "CANONICAL": (4, 0.005, 20, 2), "OTHER": (10, 0.05, 20, 2)}


def fusion_tier(known_pair: Column, up: Column, down: Column) -> Column:
    """The tier from the junction types (KNOWN, CANONICAL or UNKNOWN) of both ends."""
    are = lambda a, b: ((up == a) & (down == b)) | ((up == b) & (down == a))
    return F.when(known_pair, "KNOWN").when(are("KNOWN", "KNOWN"), "SPLICE_SPLICE").when(are("CANONICAL", "KNOWN"), "SPLICE_CANONICAL").when(are("CANONICAL", "CANONICAL"), "CANONICAL").otherwise("OTHER")


def fusion_filters(fusions: DataFrame) -> DataFrame:
    """The fusions (known_pair, known_gene, up_type, down_type, fragments, af_up, af_down, anchor_up, anchor_down, cohort) with tier and ``filters``: all limits that they miss, joined by ``;``, or PASS."""
    c = F.col
    # The tier and the tests that failed are columns of their own: written into each place that uses them, they would be evaluated dozens of times for a row.
    rows = fusions.withColumn("tier", fusion_tier(c("known_pair"), c("up_type"), c("down_type")))
    tier = c("tier")
    limit = lambda i: F.coalesce(*[F.when(tier == k, F.lit(v[i])) for k, v in FUSION_TIERS.items() if v[i] is not None])
    at_site = c("up_type").isin("KNOWN", "CANONICAL") & c("down_type").isin("KNOWN", "CANONICAL") & ((c("up_type") == "KNOWN") | (c("down_type") == "KNOWN"))
    fragments = F.when((tier == "KNOWN") & ~at_site, 4).otherwise(limit(0))
    cohort = F.when(c("known_gene") & (tier != "KNOWN"), 5).otherwise(limit(3))
    tests = {
        "min_fragment_support": c("fragments") < fragments, "min_af": F.least("af_up", "af_down") < limit(1), "min_anchor": F.least("anchor_up", "anchor_down") < limit(2), "max_cohort_frequency": F.coalesce(c("cohort") > cohort, F.lit(False)),
    }
    found = rows.withColumn("filters", F.concat_ws(";", *[F.when(t, n) for n, t in tests.items()]))
    return found.withColumn("filters", F.when(c("filters") == "", "PASS").otherwise(c("filters")))


def fusion_support(fragments: DataFrame, junction: list[str]) -> DataFrame:
    """(junction, split, realigned, discordant, max_anchor_up, max_anchor_down, af_up, af_down) from fragments (junction, kind, anchor_up, anchor_down, depth_up, depth_down).

    Frequencies are split and realigned fragments over the depth at each end; 0 without depth.
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    each = fragments.groupBy(*junction).agg(kind("SPLIT").alias("split"), kind("REALIGNED").alias("realigned"), kind("DISCORDANT").alias("discordant"), F.max("anchor_up").alias("max_anchor_up"), F.max("anchor_down").alias("max_anchor_down"), F.max("depth_up").alias("__u"), F.max("depth_down").alias("__d"))
    share = lambda d: F.when(F.col(d) > 0, (F.col("split") + F.col("realigned")) / F.col(d)).otherwise(0.0)
    return each.withColumns({"af_up": share("__u"), "af_down": share("__d")}).drop("__u", "__d")


def rna_matched(rna: DataFrame, breakends: DataFrame, distance: int, bin_size: int = 10_000) -> DataFrame:
    """The fusions found in RNA (id, gene_up, gene_down, position_up, position_down) with the variant (sv) whose breakends in the same two genes lie closest, upstream ones at or before the splice site within ``distance`` and downstream ones at or behind it; null without one.

    breakends: (sv, gene, position, upstream). Ties by sv.
    """
    up = breakends.filter("upstream").select("sv", F.col("gene").alias("gene_up"), F.col("position").alias("__a"), F.col("position").alias("__b"))
    first = I.range_join(rna.select("id", "gene_up", "gene_down", "position_down", "position_up", (F.col("position_up") + distance).alias("__e")), up, ["gene_up"], ("position_up", "__e"), ("__a", "__b"), bin_size)
    down = breakends.filter("NOT upstream").select("sv", F.col("gene").alias("gene_down"), F.col("position").alias("__c"))
    both = first.join(down, ["sv", "gene_down"]).filter((F.col("__c") <= F.col("position_down")) & (F.col("__c") >= F.col("position_down") - distance))
    best = both.groupBy("id").agg(F.min_by("sv", F.struct((F.col("__a") - F.col("position_up") + F.col("position_down") - F.col("__c")).alias("d"), "sv")).alias("sv"))
    return rna.join(best, "id", "left")


def matched_externally(own: DataFrame, other: DataFrame, keys: list[str], margin: int, bin_size: int) -> DataFrame:
    """(id, other_id): fusions of another tool (other_id, keys, up, down) for each own one (id, keys, up, down) with both ends within ``margin``; the nearest, ties by other_id; and those of either side alone with null."""
    o = other.select("other_id", *keys, F.col("up").alias("__a"), F.col("up").alias("__b"), F.col("down").alias("__c"))
    hit = I.range_join(own.withColumn("__e", F.col("up")), o, keys, ("up", "__e"), ("__a", "__b"), bin_size, slack=margin).filter(F.abs(F.col("down") - F.col("__c")) <= margin)
    best = hit.groupBy("id").agg(F.min_by("other_id", F.struct((F.abs(F.col("up") - F.col("__a")) + F.abs(F.col("down") - F.col("__c"))).alias("d"), "other_id")).alias("other_id"))
    pairs = own.select("id").join(best, "id", "left")
    alone = other.select("other_id").join(hit.select("other_id").distinct(), "other_id", "left_anti")
    return pairs.unionByName(alone.select(F.lit(None).cast(own.schema["id"].dataType).alias("id"), "other_id"))


def splice_variant_matches(variants: DataFrame, junctions: DataFrame, by: list[str], distance: int = 10, bin_size: int = 1000) -> DataFrame:
    """(id, junctions, fragments): for variants (id, by, position) the novel junctions (by, start, end, fragments) of the same sample with an end within ``distance``, each once."""
    ends = junctions.select(*by, F.struct("start", "end").alias("__j"), "fragments", F.explode(F.array_distinct(F.array("start", "end"))).alias("__a")).withColumn("__b", F.col("__a"))
    hit = I.range_join(variants.withColumn("__e", F.col("position")), ends, by, ("position", "__e"), ("__a", "__b"), bin_size, slack=distance).select("id", "__j", "fragments").distinct()
    return hit.groupBy("id").agg(F.count("*").alias("junctions"), F.sum("fragments").alias("fragments"))


def junction_filter(junctions: DataFrame, gene: str, fragments: str, least: int = 0, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Junctions with at least ``least`` fragments (if positive), of genes that are included, and none that are excluded; both are tables with the gene's column."""
    out = junctions.filter(F.col(fragments) >= least) if least > 0 else junctions
    if include is not None:
        out = out.join(include.select(gene).distinct(), gene, "left_semi")
    return out if exclude is None else out.join(exclude.select(gene).distinct(), gene, "left_anti")


def junction_type(start_known: Column, end_known: Column, same_transcript: Column, start_region: Column, end_region: Column, one_exon: Column, circular: Column) -> Column:
    """The kind of a novel junction: regions are EXONIC or INTRONIC, start is the 5' end."""
    both = F.concat_ws("-", F.array_sort(F.array(start_region, end_region)))
    return (
        F.when(circular, "CIRCULAR").when(start_known & end_known, F.when(same_transcript, "SKIPPED_EXON").otherwise("MIXED_TRANSCRIPT")).when(start_known, "NOVEL_3_PRIME_SS").when(end_known, "NOVEL_5_PRIME_SS")
        .when(one_exon, "NOVEL_INTRON").when(both == "INTRONIC-INTRONIC", "INTRONIC").when(both == "EXONIC-INTRONIC", "INTRONIC_TO_EXONIC").otherwise("EXONIC")
    )


def novel_junctions(fragments: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end, fragments, type) of junctions of fragments (keys, start, end, start_region, end_region, one_exon) that no transcript has.

    known: (keys, transcript, start, end) of annotated introns, whose ends are the known splice sites.
    """
    counted = fragments.groupBy(*keys, "start", "end").agg(F.count("*").alias("fragments"), F.first("start_region").alias("s"), F.first("end_region").alias("e"), F.bool_or("one_exon").alias("o"))
    new = counted.join(known.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_anti")
    starts = known.groupBy(*keys, "start").agg(F.collect_set("transcript").alias("__s"))
    ends = known.groupBy(*keys, "end").agg(F.collect_set("transcript").alias("__e"))
    both = new.join(starts, [*keys, "start"], "left").join(ends, [*keys, "end"], "left")
    a, b = F.col("__s").isNotNull(), F.col("__e").isNotNull()
    kind = junction_type(a, b, F.coalesce(F.arrays_overlap("__s", "__e"), F.lit(False)), F.col("s"), F.col("e"), F.col("o"), F.col("end") < F.col("start"))
    return both.select(*keys, "start", "end", "fragments", kind.alias("type"))


def retained_introns(reads: DataFrame, boundaries: DataFrame, by: list[str], least: int = 3, bin_size: int = 1000) -> DataFrame:
    """(by, boundary, reads, spliced) of exon boundaries that no other exon overlaps and that at least ``least`` reads (by, start, end, spliced) cross, or one whose fragment is spliced elsewhere."""
    r = reads.select(*by, "start", "end", "spliced")
    b = boundaries.select(*by, "boundary", F.col("boundary").alias("__a"), (F.col("boundary") + 1).alias("__b"))
    hit = I.range_join(r, b, by, ("start", "end"), ("__a", "__b"), bin_size).filter("start <= __a AND end >= __b")
    return hit.groupBy(*by, "boundary").agg(F.count("*").alias("reads"), F.count_if("spliced").alias("spliced")).filter((F.col("reads") >= least) | (F.col("spliced") >= 1))


def gc_adjusted(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(bucket, ratio) of the share of observed fragments to that of expected ones by GC bucket; expected: (transcript, bucket, share), weighted by abundance already. 1 where nothing is expected."""
    o = observed.groupBy("bucket").agg(F.sum("n").alias("o"))
    e = expected.groupBy("bucket").agg(F.sum("share").alias("e"))
    total = o.agg(F.sum("o").alias("to")).crossJoin(e.agg(F.sum("e").alias("te")))  # one row each
    both = o.join(e, "bucket", "full_outer").fillna(0, ["o", "e"]).crossJoin(F.broadcast(total))
    return both.select("bucket", F.when(F.col("e") > 0, (F.col("o") / F.col("to")) / (F.col("e") / F.col("te"))).otherwise(1.0).alias("ratio"))


def reestimated_rates(rates: DataFrame, bias: DataFrame) -> DataFrame:
    """(transcript, factor): each transcript's mean bias over its expected GC distribution (transcript, bucket, share), by which its rates are multiplied before abundances are estimated again."""
    both = rates.join(F.broadcast(bias.filter("bucket BETWEEN 0 AND 100")), "bucket", "left")  # 101 buckets
    return both.groupBy("transcript").agg((F.sum(F.col("share") * F.coalesce("ratio", F.lit(1.0))) / F.sum("share")).alias("factor"))


def panel_normalised(rows: DataFrame, factors: DataFrame, gene: str, tpm: str) -> DataFrame:
    """The rows with tpm divided by the gene's factor; genes without a positive one, or without tpm, stay."""
    both = rows.join(factors.select(gene, "factor"), gene, "left")
    return both.withColumn(tpm, F.when((F.col("factor") > 0) & (F.col(tpm) > 0), F.col(tpm) / F.col("factor")).otherwise(F.col(tpm))).drop("factor")


def panel_factors(panel: DataFrame, whole: DataFrame, gene: str, tpm: str) -> DataFrame:
    """(gene, factor): the median over samples of the panel's tpm over that of the whole transcriptome, both by (sample, gene)."""
    both = panel.select("sample", gene, F.col(tpm).alias("__p")).join(whole.select("sample", gene, F.col(tpm).alias("__w")), ["sample", gene]).filter("__w > 0")
    return both.groupBy(gene).agg(F.percentile(F.col("__p") / F.col("__w"), 0.5).alias("factor"))


def site_usage(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, site, spliced, unspliced, usage): the share of a known site's fragments that are spliced there; null without any."""
    return counts.groupBy(*by, "site").agg(F.sum("spliced").alias("spliced"), F.sum("unspliced").alias("unspliced")).withColumn("usage", F.when(F.col("spliced") + F.col("unspliced") > 0, F.col("spliced") / (F.col("spliced") + F.col("unspliced"))))


def chimeric_reads(reads: DataFrame, gap: int = 500_000) -> DataFrame:
    """(fragment, kind) of fragments that are candidates: SPLIT with a supplementary alignment, or a splice over more than ``gap``; DISCORDANT with mates on two chromosomes, too far apart or facing wrongly.

    reads: (fragment, chromosome, start, end, forward, supplementary, skipped).
    """
    each = reads.groupBy("fragment").agg(F.bool_or(F.col("supplementary") | (F.col("skipped") > gap)).alias("split"), F.count_distinct("chromosome").alias("c"), (F.max("end") - F.min("start")).alias("span"), F.count_if("forward").alias("f"), F.count("*").alias("n"))
    wrong = (F.col("c") > 1) | (F.col("span") > gap) | ((F.col("n") == 2) & (F.col("f") != 1))
    return each.select("fragment", F.when(F.col("split"), "SPLIT").when(wrong, "DISCORDANT").alias("kind")).filter("kind IS NOT NULL")


def expression_compared(own: DataFrame, other: DataFrame, keys: list[str], value: str, relative: float = 0.1) -> DataFrame:
    """(keys, status): MATCH, DIFF beyond ``relative`` of the larger, OWN_ONLY or OTHER_ONLY."""
    both = own.select(*keys, F.col(value).alias("__a")).join(other.select(*keys, F.col(value).alias("__b")), keys, "full_outer")
    far = F.abs(F.col("__a") - F.col("__b")) > relative * F.greatest(F.abs("__a"), F.abs("__b"))
    return both.select(*keys, F.when(F.col("__b").isNull(), "OWN_ONLY").when(F.col("__a").isNull(), "OTHER_ONLY").when(far, "DIFF").otherwise("MATCH").alias("status"))


def top_junctions(rows: DataFrame, keys: list[str], sample: str, count: str, most: int) -> DataFrame:
    """(keys, samples, total): the ``most`` junctions of most samples, ties by total and keys; a report."""
    each = rows.groupBy(*keys).agg(F.count_distinct(sample).alias("samples"), F.sum(count).alias("total"))
    return each.orderBy(F.desc("samples"), F.desc("total"), *keys).limit(most)



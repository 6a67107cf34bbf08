"""Filters, artefacts, annotations and cohort views of structural variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from . import intervals as I

#: Fixed thresholds of the filters: quality, fragments (hotspot, single, other), allele frequency (hotspot, single, other), lengths in bases.
QUALITY, SUPPORT, FREQUENCY = 30.0, (2, 6, 4), (0.001, 0.05, 0.001)
LENGTH, ANCHOR = 32, 50
#: Short inversions: longest, then homology and caps of the two homology classes with their factors; shortest-fragment inversions; deletions.
INV_LONGEST, INV_HOMOLOGY, INV_CAPS, INV_FACTORS = 3000, (3, 6), (0.1, 0.2), (200, 400)
INV_SHORT, INV_SHORT_CAP, INV_SHORT_FACTOR = 300, 0.05, 50
DEL_LONGEST, DEL_HOMOLOGY, DEL_FREQUENCY, DEL_FACTOR = 3000, 10, 0.05, 1.5
FRAGMENT_SPREADS, FRAGMENT_CAP = 3, 0.6
#: Adapter sequences whose insertion on one strand alone is an artefact.
FORWARD_ADAPTERS, REVERSE_ADAPTERS = ("GCCGTATCATTAAAAA", "GTAGATCTCGGTGGTC"), ("TTTTTAATGATACGGC", "GACCACCGAGATCTAC")


def filters(variants: DataFrame, median: float, spread: float, upper: float, inversion_rate: float, short_inversion_rate: float, paired: bool = True) -> DataFrame:
    """The variants with ``filters``: the names of all that fail, joined by ``;``, existing ones first, or PASS.

    variants: type, hotspot, line, known (matched to a known sequence), qual, genotypes array<struct<vf, af_start, af_end>> (af_end null for singles), length, homology,
    anchor_start, anchor_end, fragment_length, strand_bias, insert_sequence, existing array<string>. median, spread and upper describe the sample's fragment lengths. A variant passes a limit on samples if any
    sample reaches it, at both ends.
    """
    c = F.col
    single = c("type") == "SGL"
    by_kind = lambda x: F.when(c("hotspot"), x[0]).when(single & ~c("line"), x[1]).otherwise(x[2])
    reaches = lambda limit: F.exists("genotypes", lambda g: (g["af_start"] >= limit) & (g["af_end"].isNull() | (g["af_end"] >= limit)))
    anchored = (c("anchor_start") >= ANCHOR) & (single | (c("anchor_end") >= ANCHOR))
    support = F.array_max(F.transform("genotypes", lambda g: g["vf"]))
    shortest = F.least(F.lit(median) - FRAGMENT_SPREADS * spread / F.sqrt(support), F.lit(median - FRAGMENT_CAP * spread))
    low, high = (min(cap, f * inversion_rate) for cap, f in zip(INV_CAPS, INV_FACTORS))
    inverted = (c("type") == "INV") & (c("length") <= INV_LONGEST) & (c("homology") >= INV_HOMOLOGY[0])
    contains = lambda some: F.greatest(*[F.contains("insert_sequence", F.lit(x)).cast("int") for x in some]) == 1
    tests = {
        "minAF": ~c("known") & ~reaches(by_kind(FREQUENCY)),
        "minSupport": ~c("known") & (support < by_kind(SUPPORT)),
        "minQual": ~c("known") & (c("qual") < QUALITY),
        "minLength": c("type").isin("DEL", "DUP", "INS") & (c("length") < LENGTH),
        "minAnchorLength": ~c("known") & ~c("line") & ~anchored,
        "shortFrags": ~c("known") & ~single & ~c("line") & (c("fragment_length") != 0) & (c("fragment_length") < shortest) if paired else F.lit(False),
        "invShortLowVafHom": ~c("known") & inverted & ~reaches(F.when(c("homology") >= INV_HOMOLOGY[1], high).otherwise(low)),
        "invShortFragLowVaf": ~c("known") & (c("type") == "INV") & (c("length") <= INV_SHORT) & ~reaches(F.lit(min(INV_SHORT_CAP, INV_SHORT_FACTOR * short_inversion_rate))),
        "delShortLowVaf": ~c("known") & (c("type") == "DEL") & (c("length") <= DEL_LONGEST) & (c("homology") >= DEL_HOMOLOGY) & (c("fragment_length") + c("length") < DEL_FACTOR * upper) & ~reaches(F.lit(DEL_FREQUENCY)),
        "sbArtefact": ((c("strand_bias") == 1) & contains(FORWARD_ADAPTERS)) | ((c("strand_bias") == 0) & contains(REVERSE_ADAPTERS)),
    }
    found = F.array_distinct(F.concat("existing", F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))))
    return variants.withColumn("filters", F.when(F.size(found) == 0, "PASS").otherwise(F.array_join(found, ";")))


def artefacts(breakends: DataFrame, by: list[str], low: float = 0.05, isolated: int = 5000, inversion: int = 100) -> DataFrame:
    """(sv, reason) of variants that are left out before clustering, from breakends (by, sv, position, orientation, type, frequency, jcn, jcn_spread, qual), two or one a variant.

    LOW_VAF: a translocation or single of low frequency with no other variant's breakend within ``isolated`` on either side of any of its ends; or an inversion of low frequency whose two ends follow each other
    within ``inversion``. PAIR_INF: inferred breakends that follow each other with opposite orientations and junction copy numbers that agree. DUP_BE: of consecutive breakends of different variants with one orientation
    at most a base apart where one is a single, the single. The first reason in this order holds.
    """
    order = Window.partitionBy(*by).orderBy("position", "sv", "orientation")
    near = I.nearest(breakends, by, "position", "sv")
    nxt = {f"n_{c}": F.lead(c).over(order) for c in ("sv", "position", "orientation", "type", "jcn", "jcn_spread", "qual")}
    rows = near.withColumns(nxt)
    step = F.col("n_position") - F.col("position")
    remote = near.filter(F.col("type").isin("BND", "SGL") & (F.col("frequency") < low)).groupBy("sv").agg(F.min(F.coalesce("nearest", F.lit(isolated + 1))).alias("m")).filter(F.col("m") > isolated).select("sv", F.lit(0).alias("r"))
    short = rows.filter((F.col("type") == "INV") & (F.col("n_sv") == F.col("sv")) & (step <= inversion) & (F.col("frequency") < low)).select("sv", F.lit(0).alias("r"))
    agree = F.abs(F.col("jcn") - F.col("n_jcn")) <= F.greatest("jcn_spread", "n_jcn_spread")
    inferred = rows.filter((F.col("type") == "INF") & (F.col("n_type") == "INF") & (F.col("orientation") != F.col("n_orientation")) & agree).select(F.explode(F.array("sv", "n_sv")).alias("sv"), F.lit(1).alias("r"))
    close = rows.filter((F.col("n_sv") != F.col("sv")) & (F.col("orientation") == F.col("n_orientation")) & (step <= 1))
    single = F.when(F.col("type") == "SGL", F.col("sv")).when(F.col("n_type") == "SGL", F.col("n_sv"))
    twice = close.select(single.alias("sv"), F.lit(2).alias("r")).filter("sv IS NOT NULL")
    first = remote.union(short).union(inferred).union(twice).groupBy("sv").agg(F.min("r").alias("r"))
    return first.select("sv", F.get(F.array(F.lit("LOW_VAF"), F.lit("PAIR_INF"), F.lit("DUP_BE")), F.col("r")).alias("reason"))


def repeat_masked(inserts: DataFrame, masks: DataFrame, bin_size: int = 10_000, least: int = 20, share: float = 0.1) -> DataFrame:
    """(id, repeat, coverage): of each insert's alignments (id, chromosome, start, end, insert_length) the overlapping repeat (chromosome, start, end, repeat) that covers most of the insert.

    At least ``least`` bases and more than ``share`` of the insert; ties by repeat. Inserts without one are left out.
    """
    r = masks.select("chromosome", F.col("start").alias("__a"), F.col("end").alias("__b"), "repeat")
    hit = I.range_join(inserts, r, ["chromosome"], ("start", "end"), ("__a", "__b"), bin_size)
    bases = F.least("end", "__b") - F.greatest("start", "__a") + 1
    good = hit.withColumns({"__n": bases, "coverage": bases / F.col("insert_length")}).filter((F.col("__n") >= least) & (F.col("coverage") > share))
    best = F.min(F.struct((-F.col("coverage")).alias("c"), "repeat")).alias("b")
    return good.groupBy("id").agg(best).select("id", "b.repeat", (-F.col("b.c")).alias("coverage"))


def overlapping_clusters(variants: DataFrame, by: list[str], start: str, end: str, cluster: str, bin_size: int) -> DataFrame:
    """(cluster, merged): clusters with long deletions, duplications or inversions that partly overlap, neither holding the other, are one, directly or over others.

    variants: the long ones, one row each. Links come from a range join; the component's least cluster names it.
    """
    one = variants.select(*by, F.col(start).alias("a"), F.col(end).alias("b"), F.col(cluster).alias("c"))
    two = one.select(*by, F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("d"))
    hit = I.range_join(one, two, by, ("a", "b"), ("x", "y"), bin_size).filter((F.col("c") < F.col("d")) & (((F.col("a") < F.col("x")) & (F.col("b") < F.col("y"))) | ((F.col("x") < F.col("a")) & (F.col("y") < F.col("b")))))
    found = G.components(hit, "c", "d")
    return variants.select(F.col(cluster).cast("long").alias(cluster)).distinct().join(found, F.col(cluster) == F.col("node"), "left").select(cluster, F.coalesce("root", cluster).alias("merged"))


def resolved(clusters: DataFrame) -> Column:
    """The resolved type of a cluster from its counts: n, deletions, duplications, insertions, inversions, translocations, singles, inferred, line, foldbacks, facing (templated insertions), closed (a loop of high copy number).

    Single simple variants keep their type; pairs are told by what they are made of; the rest is complex.
    """
    c = F.col
    pair = c("n") == 2
    return (
        F.when(c("line"), "LINE").when(c("closed"), "DOUBLE_MINUTE")
        .when((c("n") == 1) & (c("deletions") == 1), "DEL").when((c("n") == 1) & (c("duplications") == 1), "DUP").when((c("n") == 1) & (c("insertions") == 1), "INS")
        .when((c("n") == 1) & (c("inversions") == 1), "INV").when((c("n") == 1) & (c("translocations") == 1), "UNBAL_TRANS").when((c("n") == 1) & (c("singles") == 1), "SGL").when((c("n") == 1) & (c("inferred") == 1), "INF")
        .when(pair & (c("translocations") == 2) & (c("facing") == 0), "RECIP_TRANS").when(pair & (c("translocations") == 2), "UNBAL_TRANS_TI")
        .when(pair & (c("inversions") == 2) & (c("foldbacks") == 2), "FB_INV_PAIR").when(pair & (c("inversions") == 2), "RECIP_INV")
        .when(pair & (c("singles") == 2), "SGL_PAIR_DEL").when(pair & (c("deletions") >= 1) & (c("facing") >= 1), "DEL_TI").when(pair & (c("duplications") >= 1) & (c("facing") >= 1), "DUP_TI")
        .when(pair, "PAIR_OTHER").when((c("deletions") + c("duplications") + c("insertions")) == c("n"), "SIMPLE_GRP").otherwise("COMPLEX")
    )


#: The category of each resolved type that isn't COMPLEX.
CATEGORIES = {
    "LINE": "INSERTION", "DEL": "SIMPLE", "DUP": "SIMPLE", "INS": "SIMPLE", "UNBAL_TRANS": "SIMPLE", "RECIP_TRANS": "RECIPROCAL", "RECIP_INV": "RECIPROCAL", "DUP_TI": "TEMPLATED_INSERTION",
    "DEL_TI": "TEMPLATED_INSERTION", "UNBAL_TRANS_TI": "TEMPLATED_INSERTION", "DOUBLE_MINUTE": "DOUBLE_MINUTE", "INV": "INCOMPLETE", "SGL": "INCOMPLETE", "INF": "INCOMPLETE", "PAIR_OTHER": "INCOMPLETE",
}


def category(resolved_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, resolved_type), F.lit("COMPLEX"))


def flagged(breakends: DataFrame, regions: DataFrame, bin_size: int = 100_000, slack: int = 0) -> DataFrame:
    """(id, flags): the kinds of known regions (chromosome, start, end, kind) that a breakend (id, chromosome, position) lies in, or within ``slack`` of, sorted and joined by ``;``."""
    r = regions.select("chromosome", F.col("start").alias("__a"), F.col("end").alias("__b"), "kind")
    hit = I.range_join(breakends.withColumn("__p", F.col("position")), r, ["chromosome"], ("position", "__p"), ("__a", "__b"), bin_size, slack=slack)
    kinds = hit.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("flags"))
    return breakends.select("id").distinct().join(kinds, "id", "left").fillna("", ["flags"])


def line_pairs(breakends: DataFrame, by: list[str], window: int = 100) -> DataFrame:
    """The breakends (id, by, position, orientation, line, filters) with ``rescued``: those that fail, at a LINE site, next to a passing one of the other orientation within ``window``.

    Neighbours come from bins of twice the window, each row in the two that it can meet others in.
    """
    good = breakends.filter("line AND filters = 'PASS'").select(*by, F.col("position").alias("__p"), F.col("position").alias("__q"), F.col("orientation").alias("__o"))
    bad = breakends.filter("line AND filters != 'PASS'").select("id", *by, "position", F.col("position").alias("__e"), "orientation")
    hit = I.range_join(bad, good, by, ("position", "__e"), ("__p", "__q"), 2 * window, slack=window).filter(F.col("orientation") != F.col("__o"))
    return breakends.join(hit.select("id").distinct().withColumn("rescued", F.lit(True)), "id", "left").fillna(False, ["rescued"])


def reference_support(breakends: DataFrame, reads: DataFrame, bin_size: int = 1000, overlap: int = 1) -> DataFrame:
    """Breakends (id, chromosome, position, variant_fragments, short) with ref_reads (a read spans the place), ref_pairs (only the insert does) and frequency.

    reads: (chromosome, fragment, start, end, insert_start, insert_end). A fragment counts once, as a read if one of its reads spans. Pairs are left out of the frequency for short variants.
    """
    r = reads.select("chromosome", "fragment", "start", "end", F.col("insert_start").alias("__a"), F.col("insert_end").alias("__b"))
    hit = I.range_join(breakends.withColumn("__p", F.col("position")), r, ["chromosome"], ("position", "__p"), ("__a", "__b"), bin_size)
    spans = (F.col("start") <= F.col("position") - overlap) & (F.col("end") >= F.col("position") + overlap)
    each = hit.groupBy("id", "fragment").agg(F.max(spans).alias("spans")).groupBy("id").agg(F.count_if("spans").alias("ref_reads"), F.count_if(~F.col("spans")).alias("ref_pairs"))
    out = breakends.join(each, "id", "left").fillna(0, ["ref_reads", "ref_pairs"])
    all_ = F.col("variant_fragments") + F.col("ref_reads") + F.when(F.col("short"), 0).otherwise(F.col("ref_pairs"))
    return out.withColumn("frequency", F.when(all_ > 0, F.col("variant_fragments") / all_).otherwise(0.0))


def homozygous_disruptions(breakends: DataFrame) -> DataFrame:
    """(gene, kind) of genes whose every copy a variant breaks, from breakends (gene, type, orientation, bridged, undisrupted, exonic, span_undisrupted).

    DEL: a breakend that faces away over a deletion bridge and leaves less than half a copy undisrupted, on it and on its partner. DUP: the lower end of an exonic duplication that leaves
    less than half a copy. One row for each gene and kind.
    """
    c = F.col
    deleted = (c("orientation") == 1) & c("bridged") & (c("undisrupted") < 0.5) & (c("span_undisrupted") < 0.5)
    duplicated = (c("orientation") == -1) & (c("type") == "DUP") & c("exonic") & (c("undisrupted") < 0.5)
    return breakends.select("gene", F.when(deleted, "HOM_DEL_DISRUPTION").when(duplicated, "HOM_DUP_DISRUPTION").alias("kind")).filter("kind IS NOT NULL").distinct()


def germline_disruptions(disruptions: DataFrame, panel: DataFrame, frequency: Column, most: float = 0.01, long_: int = 5_000_000) -> DataFrame:
    """The disruptions (sv, gene, type, length, filters, panel_samples, samples) with ``reported``: passing, of a panel gene, rare in the cohort, and no pseudogene-like or long deletion or duplication."""
    genes = panel.select("gene", F.lit(True).alias("__in"))
    ok = F.col("__in").isNotNull() & (F.col("filters") == "PASS") & (frequency <= most) & ~(F.col("type").isin("DEL", "DUP") & (F.col("length") > long_))
    return disruptions.join(genes, "gene", "left").withColumn("reported", ok).drop("__in")


def telomeric_breakends(sites: DataFrame, by: list[str], position: str, gap: int = 50, *ties: str) -> DataFrame:
    """The sites with ``filters``. sites: by (chromosome, orientation, telomeric orientation), position, germline, tumor, telomeric, anchor, split, pairs, mapq.

    Of sites within ``gap`` of the one before, all but the one with most split reads (ties by position, then the columns given) are duplicates.
    """
    marked = I.islands(sites, by, position, gap)
    order = Window.partitionBy(*by, "island").orderBy(F.desc("split"), position, *ties)
    c = F.col
    tests = {
        "maxGermlineSupport": c("germline") >= F.least(F.lit(5.0), 0.02 * c("tumor")), "minTelomericLength": c("telomeric") < 20, "minAnchorLength": c("anchor") < 50, "minSplitReads": c("split") < 3,
        "minDiscordantPairs": c("pairs") <= 0, "minTumorMAPQ": c("mapq") < 300, "duplicate": F.row_number().over(order) > 1,
    }
    found = F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))
    return marked.withColumn("filters", F.when(F.size(found) == 0, "PASS").otherwise(F.array_join(found, ";"))).drop("island")


def shared_variants(variants: DataFrame, margin: int = 10, bin_size: int = 1000) -> DataFrame:
    """(id, samples): for each variant (id, patient, sample, chr1, pos1, or1, chr2, pos2, or2), in how many biopsies of its patient it stands, both ends within ``margin``."""
    keys = ["patient", "chr1", "or1", "chr2", "or2"]
    a = variants.select("id", *keys, "pos1", F.col("pos1").alias("__e"), "pos2")
    b = variants.select(*keys, F.col("sample").alias("__s"), F.col("pos1").alias("__a"), F.col("pos1").alias("__b"), F.col("pos2").alias("__c"))
    hit = I.range_join(a, b, keys, ("pos1", "__e"), ("__a", "__b"), bin_size, slack=margin).filter(F.abs(F.col("pos2") - F.col("__c")) <= margin)
    return hit.groupBy("id").agg(F.count_distinct("__s").alias("samples"))


def length_bins(variants: DataFrame, sample: str, kind: str, length: str) -> DataFrame:
    """(sample, context, n): counts by type and decade of length, from 1 kb to 10 Mb; translocations have no length."""
    edges = [0, 10**3, 10**4, 10**5, 10**6, 10**7]
    n = F.col(length)
    name = F.lit(f"{edges[-1]:.0e}_Inf")
    for a, b in reversed(list(zip(edges, edges[1:]))):
        name = F.when(n < b, f"{a:.0e}_{b:.0e}").otherwise(name)
    context = F.when(F.col(kind) == "TRA", "TRA").otherwise(F.concat_ws("_", kind, F.regexp_replace(name, "[+]", "")))
    return variants.groupBy(sample, context.alias("context")).agg(F.count("*").alias("n"))

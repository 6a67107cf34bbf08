"""Effects of variants on transcripts, alone and in phase, and what is reported of them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import translated
from . import intervals as I

#: Fixed ranges: bases upstream of a gene, intronic and exonic bases of a splice region, splice positions behind and before an exon.
UPSTREAM, SPLICE_INTRON, SPLICE_EXON = 1000, 8, 3
DONOR, ACCEPTOR = (1, 2, 5), (1, 2)
#: Fixed order of coding effects, worst first, and the effects of each; others have none.
CODING_EFFECTS = {
    "NONSENSE_OR_FRAMESHIFT": ["stop_gained", "frameshift", "start_lost", "stop_lost"], "SPLICE": ["splice_donor", "splice_acceptor"],
    "MISSENSE": ["missense", "inframe_insertion", "inframe_deletion", "phased_inframe_insertion", "phased_inframe_deletion", "phased_missense"], "SYNONYMOUS": ["synonymous", "phased_synonymous"],
}


def coding_effect(effects: Column) -> Column:
    """The worst coding effect of an array of effects, or NONE."""
    out = F.lit("NONE")
    for name, some in reversed(CODING_EFFECTS.items()):
        out = F.when(F.arrays_overlap(effects, F.array(*[F.lit(x) for x in some])), name).otherwise(out)
    return out


def _exonic(variants: DataFrame, transcripts: DataFrame, exons: DataFrame, bin_size: int) -> DataFrame:
    """Variants by transcript in reach, with what the transcript's exons say: the one that holds the variant's position, the nearest ends, and the coding bases before it."""
    reach = transcripts.withColumns({"__a": F.col("trans_start") - F.when(F.col("strand") > 0, UPSTREAM).otherwise(0), "__b": F.col("trans_end") + F.when(F.col("strand") > 0, 0).otherwise(UPSTREAM)})
    spans = variants.withColumn("__q", F.col("position") + F.greatest(F.length("ref"), F.lit(1)) - 1)
    near = I.range_join(spans, reach, ["chromosome"], ("position", "__q"), ("__a", "__b"), bin_size)
    both = near.join(exons.select("transcript", "exon_start", "exon_end"), "transcript")
    c = F.col
    p, q, plus = c("position"), c("__q"), c("strand") > 0
    inserted, deleted = F.length("ref") == 0, F.length("ref") > F.length("alt")
    inside = (p <= c("exon_end")) & (q >= c("exon_start"))
    # Coding bases of this exon before the first changed one, in the transcript's direction, and those that the change takes.
    low, high = F.greatest("exon_start", "coding_start"), F.least("exon_end", "coding_end")
    before = F.when(plus, F.least(high, F.when(inserted, p).otherwise(p - 1)) - low + 1).otherwise(high - F.greatest(low, q + 1) + 1)
    taken = F.when(inserted, 0).otherwise(F.least(high, q) - F.greatest(low, p) + 1)
    behind_end, before_start = p - c("exon_end"), c("exon_start") - p  # intronic distances, positive outside
    inner_end, inner_start = c("exon_end") != c("trans_end"), c("exon_start") != c("trans_start")
    distance = lambda d, inner: F.when(inner & (d >= -SPLICE_EXON + 1) & (d <= SPLICE_INTRON), d)
    end, start = distance(behind_end, inner_end), distance(before_start, inner_start)
    # A deletion may take splice positions from either side.
    takes = lambda places: deleted & reduce(or_, [(x >= p) & (x <= q) for x in places])
    beyond = lambda places: [c("exon_end") + k for k in places]
    ahead = lambda places: [c("exon_start") - k for k in places]
    takes_donor = F.when(plus, inner_end & takes(beyond(DONOR))).otherwise(inner_start & takes(ahead(DONOR)))
    takes_acceptor = F.when(plus, inner_start & takes(ahead(ACCEPTOR))).otherwise(inner_end & takes(beyond(ACCEPTOR)))
    keys = ["id", "transcript"]
    first = [F.first(x).alias(x) for x in ("gene", "strand", "trans_start", "trans_end", "coding_start", "coding_end", "position", "__q", "ref", "alt", "lps")]
    sums = lambda x: F.coalesce(F.sum(F.when(F.col("coding_start").isNotNull(), F.greatest(F.lit(0), x))), F.lit(0))
    return both.groupBy(*keys).agg(
        *first, F.bool_or(inside).alias("exonic"), sums(before).alias("offset"), sums(taken).alias("taken"), F.bool_or(takes_donor).alias("takes_donor"), F.bool_or(takes_acceptor).alias("takes_acceptor"),
        F.min(F.when(plus, end).otherwise(start)).alias("donor"), F.min(F.when(plus, start).otherwise(end)).alias("acceptor"),
    )


def effects(variants: DataFrame, transcripts: DataFrame, exons: DataFrame, coding: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """(id, transcript, gene, effects, coding_effect, splice_region, codon, ref_codon, alt_codon) of variants (id, chromosome, position, ref, alt, lps) for each transcript in reach.

    transcripts: (transcript, gene, chromosome, strand, trans_start, trans_end, coding_start, coding_end; the last two null without a protein); exons: (transcript, exon_start, exon_end); coding: (transcript, bases) in the transcript's direction. ref and alt have
    no common base; of an insertion ref is empty and position is the base before it. Codons are given for substitutions of one base. Effects stand in the order
    found: upstream, splice site, coding effect or untranslated region, a start or stop that it changes, intronic. A deletion over an exon's end that takes splice positions has their effect, and its frame is that of the coding bases
    that it takes.
    """
    c = F.col
    rows = _exonic(variants, transcripts, exons, bin_size).join(coding.select("transcript", F.col("bases").alias("__bases")), "transcript", "left")
    plus, p, q = c("strand") > 0, c("position"), c("__q")
    upstream = (plus & (q < c("trans_start"))) | (~plus & (p > c("trans_end")))
    has_coding = c("coding_start").isNotNull()
    in_coding = has_coding & (q >= c("coding_start")) & (p <= c("coding_end"))
    left = has_coding & (q < c("coding_start"))
    right = has_coding & (p > c("coding_end"))
    old_size, new_size = F.length("ref"), F.length("alt")
    shift = new_size - F.when(old_size > new_size, F.least(c("taken"), old_size)).otherwise(old_size)
    single = (old_size == 1) & (new_size == 1)
    codon = F.floor(c("offset") / 3).cast("int")
    ref_codon = F.substring("__bases", codon * 3 + 1, F.lit(3))
    base = F.when(plus, c("alt")).otherwise(F.translate(F.reverse("alt"), "ACGT", "TGCA"))
    place = (c("offset") % 3).cast("int")
    alt_codon = F.concat(F.substring(ref_codon, F.lit(1), place), base, F.substring(ref_codon, place + 2, F.lit(3)))
    old, new = translated(ref_codon), translated(alt_codon)
    changed = F.when(old == new, "synonymous").when((codon == 0) & (old == "M"), "start_lost").when(new == "*", "stop_gained").when(old == "*", "stop_lost").otherwise("missense")
    of_indel = F.when(shift % 3 != 0, "frameshift").when(shift > 0, "inframe_insertion").when(shift < 0, "inframe_deletion")
    # Whole codons around a change that lies within one exon: their residues before and after.
    size = (F.ceil((place + old_size) / 3) * 3).cast("int")
    window = F.substring("__bases", codon * 3 + 1, size)
    after = F.concat(F.substring(window, F.lit(1), place), base, F.substring(window, place + old_size + 1, size))
    was, becomes = translated(window), translated(after)
    whole = ~single & in_coding & c("exonic") & (shift % 3 == 0) & (c("taken") == old_size) & (F.length(window) == size)
    edge = F.when(whole, F.when((codon == 0) & was.startswith("M") & ~becomes.startswith("M") & (becomes != ""), "start_lost").when(~was.endswith("*") & F.contains(becomes, F.lit("*")), "stop_gained").when(was.endswith("*") & ~F.contains(becomes, F.lit("*")) & (becomes != ""), "stop_lost"))
    of_several = F.coalesce(of_indel, F.when(edge.isNotNull(), None).when(whole & (was == becomes), "synonymous").otherwise("missense"))
    exon_effect = (
        F.when(~c("exonic"), None).when(~has_coding, "non_coding_transcript").when(left, F.when(plus, "five_prime_utr").otherwise("three_prime_utr")).when(right, F.when(plus, "three_prime_utr").otherwise("five_prime_utr"))
        .when(in_coding & single, changed).when(in_coding, of_several)
    )
    donor = c("takes_donor") | c("donor").isin(*DONOR) | ((c("donor") == 0) & single & c("exonic"))
    acceptor = c("takes_acceptor") | c("acceptor").isin(*ACCEPTOR) | ((c("acceptor") == 3) & (base == "G") & single)
    intronic = ~c("exonic") & ~upstream
    found = F.array_compact(F.array(F.when(upstream, "upstream_gene"), F.when(F.coalesce(donor, F.lit(False)), "splice_donor"), F.when(F.coalesce(acceptor, F.lit(False)), "splice_acceptor"), exon_effect, edge, F.when(intronic, "intronic")))
    known = in_coding & single & c("exonic")
    out = rows.withColumns({"effects": found, "splice_region": c("donor").isNotNull() | c("acceptor").isNotNull(), "codon": F.when(known, codon), "ref_codon": F.when(known, ref_codon), "alt_codon": F.when(known, alt_codon)})
    return out.select("id", "transcript", "gene", "lps", F.when(in_coding & c("exonic"), shift).alias("shift"), "effects", coding_effect(F.col("effects")).alias("coding_effect"), "splice_region", "codon", "ref_codon", "alt_codon")


def phased(impacts: DataFrame) -> DataFrame:
    """The impacts with ``phased``, effects joined by ``;`` (null where phase changes nothing): of frameshifts in one phase set and transcript whose shifts add up to whole codons, an inframe change; of single bases in one codon, the change of the codon with all of them.

    A codon changed by several bases is phased_synonymous where the residue stays; else start_lost in the first codon and stop_lost in a stop codon, or phased_missense, with stop_gained if a stop comes of it.
    impacts: as ``effects`` gives them. Rows without a phase set stay alone. Unlike bases at one place can't stand on one molecule: such codons are not combined. Equal rows count once.
    """
    c = F.col
    own = Window.partitionBy("lps", "transcript")
    shifts = F.sum(F.when(c("shift") % 3 != 0, c("shift"))).over(own)
    many = F.count_if(c("shift") % 3 != 0).over(own)
    frame = F.when((c("shift") % 3 != 0) & (many > 1) & (shifts % 3 == 0), F.when(shifts > 0, "phased_inframe_insertion").when(shifts < 0, "phased_inframe_deletion").otherwise("phased_missense"))
    codon = Window.partitionBy("lps", "transcript", "codon")
    differing = lambda i: F.when(F.substring("alt_codon", i, 1) != F.substring("ref_codon", i, 1), F.substring("alt_codon", i, 1))
    whole = F.concat(*[F.coalesce(F.max(differing(i)).over(codon), F.substring("ref_codon", i, 1)) for i in (1, 2, 3)])
    agree = [F.coalesce(F.min(differing(i)).over(codon) == F.max(differing(i)).over(codon), F.lit(True)) for i in (1, 2, 3)]
    several = F.min("alt_codon").over(codon) != F.max("alt_codon").over(codon)
    old, new = translated(c("ref_codon")), translated(whole)
    change = F.when(old == new, "phased_synonymous").when(c("codon") == 0, "start_lost").when(old == "*", "stop_lost").when(new == "*", "phased_missense;stop_gained").otherwise("phased_missense")
    change = F.when(c("codon").isNotNull() & several & agree[0] & agree[1] & agree[2], change)
    return impacts.withColumn("phased", F.when(c("lps").isNotNull(), F.coalesce(frame, change)))


def pathogenicity(significance: Column, conflicting: Column) -> Column:
    """PATHOGENIC, LIKELY_PATHOGENIC, BENIGN, LIKELY_BENIGN, CONFLICTING or UNKNOWN of a database's significance, such as ``Pathogenic/Likely_pathogenic``; a conflict without any benign or uncertain vote is likely pathogenic."""
    has = lambda col, x: F.contains(F.coalesce(col, F.lit("")), F.lit(x))
    conflict = has(significance, "Conflicting")
    worst = has(conflicting, "athogenic") & ~has(conflicting, "enign") & ~has(conflicting, "Uncertain")
    return (
        F.when(conflict & worst, "LIKELY_PATHOGENIC").when(conflict, "CONFLICTING").when(has(significance, "Pathogenic"), "PATHOGENIC").when(has(significance, "Likely_pathogenic"), "LIKELY_PATHOGENIC")
        .when(has(significance, "Benign"), "BENIGN").when(has(significance, "Likely_benign"), "LIKELY_BENIGN").otherwise("UNKNOWN")
    )


def reported(variants: DataFrame, panel: DataFrame) -> DataFrame:
    """The variants (gene, coding_effect, hotspot, repeat_count, inframe, filters) with ``reported``: passing, and of a panel gene (gene, category, missense, nonsense, splice, hotspot_only) that reports the effect; an inframe change of an oncogene in a long repeat only as a hotspot."""
    g = panel.select("gene", F.col("category").alias("__c"), F.col("missense").alias("__m"), F.col("nonsense").alias("__n"), F.col("splice").alias("__s"), F.col("report_hotspot").alias("__h"))
    c = F.col
    wanted = F.when(c("coding_effect") == "MISSENSE", c("__m")).when(c("coding_effect") == "NONSENSE_OR_FRAMESHIFT", c("__n")).when(c("coding_effect") == "SPLICE", c("__s")).otherwise(False)
    repeat = (c("__c") == "ONCO") & c("inframe") & (c("repeat_count") >= 4)
    ok = (c("filters") == "PASS") & ((c("hotspot") & c("__h")) | (wanted & ~repeat))
    return variants.join(g, "gene", "left").withColumn("reported", F.coalesce(ok, F.lit(False))).drop("__c", "__m", "__n", "__s", "__h")


def germline_likelihood(af: Column, purity: Column, copies: Column, minor: Column) -> tuple[Column, Column]:
    """How far a raw frequency lies from what a germline and a somatic variant would show in a mix with normal cells: the distance of least size among the alleles' and the homozygous one; a frequency under a single somatic copy's is no distance (a subclone)."""
    major = copies - minor
    rest = 2 * (1 - purity) + copies * purity
    nearer = lambda a, b: F.when(F.abs(a) < F.abs(b), a).otherwise(b)
    germline = nearer(F.lit(1.0) - af, nearer((1 - purity + major * purity) / rest - af, (1 - purity + minor * purity) / rest - af))
    one = purity / rest
    somatic = nearer(one - af, nearer(major * purity / rest - af, minor * purity / rest - af))
    return germline, F.when(af < one, 0.0).otherwise(somatic)


def germline_filters(variants: DataFrame, low_vaf: float = 0.1, low_copies: float = 0.5, rescue_reads: int = 3, rescue_copies: float = 0.5) -> DataFrame:
    """The germline variants (vaf, reads, copies, biallelic_risk, pathogenic) with ``filters``, in the order of the rules: LOW_VAF by genotype, taken back with enough reads and copies; LOW_TUMOR_VCN unless pathogenic; else PASS."""
    c = F.col
    first = (c("vaf") < low_vaf) & ~((c("reads") >= rescue_reads) & (c("copies") >= rescue_copies))
    second = (c("copies") < low_copies) & ~c("pathogenic")
    return variants.withColumn("filters", F.when(first & second, "LOW_VAF;LOW_TUMOR_VCN").when(first, "LOW_VAF").when(second, "LOW_TUMOR_VCN").otherwise("PASS"))


def moved_by_contamination(variants: DataFrame, level: float, factor: float = 2.5, margin: float = 0.02) -> DataFrame:
    """The germline structural variants (filters, normal_alt, normal_ref, tumor_alt, tumor_ref) with ``somatic``: passing ones whose frequency in the normal is below factor * level + margin times that in the tumor, where the normal holds tumor cells at ``level``; none at level 0."""
    c = F.col
    share = lambda a, r: F.when(c(a) + c(r) > 0, c(a) / (c(a) + c(r))).otherwise(0.0)
    limit = factor * level + margin
    moves = F.lit(level > 0) & (c("filters") == "PASS") & (share("tumor_alt", "tumor_ref") > 0) & (share("normal_alt", "normal_ref") < limit * share("tumor_alt", "tumor_ref"))
    return variants.withColumn("somatic", moves)

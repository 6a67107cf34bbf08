"""Fragments and reads: unmapping, merging of groups, consensus, overlapping mates, jitter, enrichment and file statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G
from . import intervals as I

#: Fixed values of unmapping: bases outside a problem region, very high depth, longest proper fragment, least soft clip.
OUTSIDE, HIGH_DEPTH, PROPER, CLIPPED = 10, 1000, 1000, 20
#: Fixed values of jitter: floor of rates, factors and limits of the tests.
RATE_FLOOR, RATE_FACTOR, HOTSPOT_FACTOR, HOTSPOT_RATE, HARD_P, SOFT_P = 1e-4, 2.0, 1.5, 0.03, 0.05, 0.00025


def unmapped(reads: DataFrame, regions: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """The reads (id, chromosome, start, end, clip, discordant, fragment, secondary) with ``action``: UNMAP or DELETE (secondary and supplementary ones), else null.

    A read goes if fewer than ten of its bases lie outside problem regions (chromosome, start, end, depth; disjoint) and a region is very deep, the pair is discordant or too long, or the soft clip is long; a secondary one in any such region.
    """
    r = regions.select("chromosome", F.col("start").alias("__a"), F.col("end").alias("__b"), F.col("depth").alias("__d"))
    hit = I.range_join(reads.select("id", "chromosome", "start", "end"), r, ["chromosome"], ("start", "end"), ("__a", "__b"), bin_size)
    each = hit.groupBy("id").agg(F.sum(F.least("end", "__b") - F.greatest("start", "__a") + 1).alias("__in"), F.max("__d").alias("__depth"))
    c = F.col
    both = reads.join(each, "id", "left")
    inside = (c("end") - c("start") + 1 - c("__in")) < OUTSIDE
    bad = (c("__depth") > HIGH_DEPTH) | c("discordant") | (c("fragment") > PROPER) | (c("clip") >= CLIPPED)
    return both.withColumn("action", F.when(inside & c("secondary"), "DELETE").when(inside & bad, "UNMAP")).drop("__in", "__depth")


def merged_groups(groups: DataFrame, jitter: int = 10) -> DataFrame:
    """(id, merged) of duplicate groups (id, umi, five, three, mapped): those of one identifier with an equal end on one side and ends within ``jitter`` on the other, and, where the mate is unmapped and the identifier runs out into G, those of the same end whose identifiers agree before that run.

    Groups meet by identifier and equal end, sorted by the other one, so links are as many as groups; unmapped ones and those whose identifiers agree with theirs
    are tied to the least unmapped one of their end and part before the run.
    """
    links = []
    for same, other in (("five", "three"), ("three", "five")):
        order = Window.partitionBy("umi", same).orderBy(other, "id")
        rows = groups.filter("mapped").select("id", F.lag("id").over(order).alias("b"), (F.col(other) - F.lag(other).over(order)).alias("g"))
        links.append(rows.filter(F.col("g") <= jitter).select(F.col("id").alias("a"), "b"))
    stem = F.regexp_replace("umi", "G+$", "")
    lost = groups.filter("NOT mapped").filter(F.col("umi").endswith("G")).select(F.col("id").alias("a"), "five", stem.alias("stem"), F.length("umi").alias("n"))
    hubs = lost.groupBy("five", "n", "stem").agg(F.min("a").alias("a")).withColumn("k", F.length("stem"))
    lengths = hubs.select("five", "n", "k").distinct()
    whole = groups.select(F.col("id").alias("b"), "five", F.col("umi"), F.length("umi").alias("n")).join(lengths, ["five", "n"])
    met = whole.select("b", "five", "n", F.expr("substring(umi, 1, k)").alias("stem")).join(hubs, ["five", "n", "stem"]).filter("a != b").select("a", "b")
    found = G.components(links[0].union(links[1]).union(met), "a", "b")
    return groups.select(F.col("id").cast("long").alias("id")).join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("merged"))


def template_reads(reads: DataFrame, group: str) -> DataFrame:
    """(group, template, cigar, share): of each group's reads (group, id, cigar, qual) the most common alignment, ties by its text, and of its reads the best (ties by id), which an indel consensus starts from."""
    counts = reads.groupBy(group, "cigar").agg(F.count("*").alias("n"), F.max_by("id", F.struct("qual", F.col("id"))).alias("template"))
    best = counts.groupBy(group).agg(F.max(F.struct("n", "cigar", "template")).alias("b"), F.sum("n").alias("t"))
    return best.select(group, "b.template", "b.cigar", (F.col("b.n") / F.col("t")).alias("share"))


def consensus_by_place(bases: DataFrame, keys: list[str], low: int = 0) -> DataFrame:
    """(keys, base, qual) from (keys, base, qual, strand): the base with the highest sum of qualities, ties by base; its quality is that sum less the others', not below ``low``; bases of both strands that disagree give N with ``low``."""
    sums = bases.groupBy(*keys, "base").agg(F.sum("qual").alias("q"), F.count_distinct("strand").alias("s"))
    own = Window.partitionBy(*keys)
    total, strands = F.sum("q").over(own), F.count("*").over(own)
    ranked = sums.withColumns({"__t": total, "__n": F.row_number().over(own.orderBy(F.desc("q"), "base")), "__k": strands})
    both = ranked.filter("__n = 1")
    split = (F.col("__k") > 1) & (F.col("s") < 2) & (2 * F.col("q") - F.col("__t") <= 0)
    return both.select(*keys, F.when(split, "N").otherwise(F.col("base")).alias("base"), F.when(split, low).otherwise(F.greatest(F.lit(low), 2 * F.col("q") - F.col("__t"))).alias("qual"))


def synced(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """(name, start, end, overlap, outcome) of fragments from both reads (name, chromosome, start, end, indels): their union where they overlap without indels that differ, NO_OVERLAP, DIFFERENT_CHROMOSOME or CIGAR_MISMATCH otherwise, with the first read's span."""
    b = second.select(name, F.col("chromosome").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("indels").alias("__i"))
    c = F.col
    both = first.join(b, name)
    shared = F.least("end", "__e") - F.greatest("start", "__s") + 1
    outcome = F.when(c("chromosome") != c("__c"), "DIFFERENT_CHROMOSOME").when(shared <= 0, "NO_OVERLAP").when(~c("indels").eqNullSafe(c("__i")), "CIGAR_MISMATCH").otherwise("COMBINED")
    good = outcome == "COMBINED"
    return both.select(name, F.when(good, F.least("start", "__s")).otherwise(c("start")).alias("start"), F.when(good, F.greatest("end", "__e")).otherwise(c("end")).alias("end"), F.when(good, shared).otherwise(0).alias("overlap"), outcome.alias("outcome"))


def jitter_outcome(full: Column, shortened: Column, lengthened: Column, short_rate: Column, long_rate: Column, hotspot: Column, p_value) -> Column:
    """HARD, SOFT or NONE: whether a variant's support is what neighbouring repeat counts give by jitter.

    p_value(k, n, rate) gives the chance of at most k of n at a rate. Each neighbour with more support than the variant is tested at its modelled rate, and both together at the mean rate where both exceed it.
    """

    def test(other: Column, rate: Column) -> Column:
        rate = F.greatest(rate, F.lit(RATE_FLOOR))
        total = full + other
        actual = full / total
        factor = F.when(hotspot & (rate >= HOTSPOT_RATE), HOTSPOT_FACTOR).otherwise(RATE_FACTOR)
        p = 1 - p_value(full - 1, total, rate)
        near = actual < factor * rate
        applies = (other > full) & (full > 0)
        return F.when(applies & (p > HARD_P), F.when(hotspot, 1).otherwise(2)).when(applies & ((p > SOFT_P) | near), 1).otherwise(0)

    both = F.when(F.least(shortened, lengthened) > full, test(shortened + lengthened, (short_rate + long_rate) / 2)).otherwise(0)
    worst = F.greatest(test(shortened, short_rate), test(lengthened, long_rate), both)
    return F.when(worst == 2, "HARD").when(worst == 1, "SOFT").otherwise("NONE")


def off_target(regions: DataFrame, targets: DataFrame, masks: DataFrame, bin_size: int, slack: int = 0) -> DataFrame:
    """High-depth regions (id, chromosome, start, end) that no target (chromosome, start, end) meets within ``slack``, with ``repeat``: the kind of mask that covers most of each, ties by name, null without one."""
    t = targets.select("chromosome", F.col("start").alias("__a"), F.col("end").alias("__b"))
    near = I.range_join(regions, t, ["chromosome"], ("start", "end"), ("__a", "__b"), bin_size, slack=slack).select("id").distinct()
    off = regions.join(near, "id", "left_anti")
    m = masks.select("chromosome", F.col("start").alias("__c"), F.col("end").alias("__d"), "repeat")
    hit = I.range_join(off, m, ["chromosome"], ("start", "end"), ("__c", "__d"), bin_size)
    cover = hit.groupBy("id", "repeat").agg(F.sum(F.least("end", "__d") - F.greatest("start", "__c") + 1).alias("n"))
    best = cover.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "repeat")).alias("b")).select("id", "b.repeat")
    return off.join(best, "id", "left")


def region_values(positions: DataFrame, regions: DataFrame, value: str, fallback: float, bin_size: int) -> DataFrame:
    """Positions (id, chromosome, position) with the value of the disjoint region that holds them, or the fallback."""
    r = regions.select("chromosome", F.col("start").alias("__a"), F.col("end").alias("__b"), value)
    found = I.range_join(positions.withColumn("__p", F.col("position")), r, ["chromosome"], ("position", "__p"), ("__a", "__b"), bin_size, "left")
    return found.select(*positions.columns, F.coalesce(value, F.lit(fallback)).alias(value))


def window_fragments(fragments: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, window, n, mean_length, mean_gc) of fragments (by, start, length, gc) by the window of their start."""
    return fragments.groupBy(*by, F.floor(F.col("start") / size).alias("window")).agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), F.avg("gc").alias("mean_gc"))


def file_statistics(reads: DataFrame, by: list[str]) -> DataFrame:
    """(by, reads, bases, gc, mean_quality, umis) of FASTQ reads (by, name, bases, qualities): quality signs count from 33, the identifier is what follows the name's last underscore."""
    quality = F.aggregate(F.transform(F.filter(F.split("qualities", ""), lambda q: q != ""), lambda q: F.ascii(q) - 33), F.lit(0).cast("long"), lambda s, q: s + q)
    n = F.length("bases")
    each = reads.select(*by, n.alias("n"), (n - F.length(F.translate("bases", "GC", ""))).alias("g"), quality.alias("q"), F.substring_index("name", "_", -1).alias("u"))
    return each.groupBy(*by).agg(F.count("*").alias("reads"), F.sum("n").alias("bases"), (F.sum("g") / F.sum("n")).alias("gc"), (F.sum("q") / F.sum("n")).alias("mean_quality"), F.count_distinct("u").alias("umis"))


def repeat_frequencies(sequences: DataFrame, unit: int, least: int) -> DataFrame:
    """(repeat, length, n): how often runs of each unit occur, by number of repeats, in the sequences (sequence)."""
    pattern = f"(([ACGT]{{{unit}}})\\2{{{least - 1},}})"
    runs = sequences.select(F.explode(F.regexp_extract_all("sequence", F.lit(pattern), F.lit(1))).alias("run"))
    return runs.groupBy(F.substring("run", 1, unit).alias("repeat"), F.floor(F.length("run") / unit).cast("int").alias("length")).agg(F.count("*").alias("n"))


def low_complexity(windows: DataFrame, sequence: str, k: int, share: float) -> DataFrame:
    """The rows with ``distinct`` (the share of distinct k-mers among a window's) and ``low`` (under ``share``); null for windows shorter than k."""
    from ..functions.sequences import kmers

    all_ = kmers(F.col(sequence), k)
    distinct = F.when(F.size(all_) > 0, F.size(F.array_distinct(all_)) / F.size(all_))
    return windows.withColumn("distinct", distinct).withColumn("low", F.col("distinct") < share)


def tolerant_mismatch(a: Column, b: Column, quality: Column, low: int = 20) -> Column:
    """Penalty of two equal-length sequences: 1 for each differing base of high quality, a half for others; qualities as numbers in an array."""
    pairs = F.zip_with(F.filter(F.split(a, ""), lambda x: x != ""), F.filter(F.split(b, ""), lambda x: x != ""), lambda x, y: x != y)
    cost = F.zip_with(pairs, quality, lambda d, q: F.when(d & (q >= low), 1.0).when(d, 0.5).otherwise(0.0))
    return F.aggregate(cost, F.lit(0.0), lambda s, x: s + x)


def deduplicated_assemblies(rows: DataFrame, by: list[str], band: int, most: float) -> DataFrame:
    """(id, kept): assemblies (by, position, id, sequence, support) of which another of more support (ties by id) within ``band`` positions has the same sequence but for ``most`` differences are dropped. Pairs come from a range join over the band."""
    from ..functions.sequences import hamming_within

    a = rows.withColumn("__e", F.col("position"))
    b = rows.select(*by, F.col("position").alias("__a"), F.col("position").alias("__b"), F.col("id").alias("__id"), F.col("sequence").alias("__q"), F.col("support").alias("__s"))
    hit = I.range_join(a, b, by, ("position", "__e"), ("__a", "__b"), max(1, 2 * band), slack=band)
    better = (F.col("__s") > F.col("support")) | ((F.col("__s") == F.col("support")) & (F.col("__id") < F.col("id")))
    lost = hit.filter(better & (hamming_within(F.col("sequence"), F.col("__q"), int(most)))).select("id").distinct()
    return rows.select("id").join(lost.withColumn("__no", F.lit(True)), "id", "left").select("id", F.col("__no").isNull().alias("kept"))


def chains(links: DataFrame, ends: DataFrame) -> DataFrame:
    """(chain, breakend, variant): breakends (breakend, variant) that variants and links (a, b, length) tie together, named by the least breakend.

    A breakend takes part in at most one link. Links are taken round by round: those that are the shortest (ties by a, b) at both their breakends, until none is left; rounds and state are written to the shared folder.
    """
    from ..storage import stored

    left = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "length"), "links")
    taken = None
    while True:
        key = F.struct("length", "a", "b")
        both = left.select(F.col("a").alias("e"), key.alias("k")).union(left.select(F.col("b").alias("e"), key.alias("k")))
        best = both.groupBy("e").agg(F.min("k").alias("k"))
        pick = left.withColumn("k", key).join(best.select(F.col("e").alias("a"), F.col("k").alias("ka")), "a").join(best.select(F.col("e").alias("b"), F.col("k").alias("kb")), "b").filter("k = ka AND k = kb").select("a", "b")
        pick = stored(pick, "picked")
        if pick.isEmpty():
            break
        taken = pick if taken is None else taken.union(pick)
        used = pick.select(F.col("a").alias("e")).union(pick.select(F.col("b").alias("e")))
        left = stored(left.join(used.withColumnRenamed("e", "a"), "a", "left_anti").join(used.withColumnRenamed("e", "b"), "b", "left_anti").select("a", "b", "length"), "links")
    pair = ends.groupBy("variant").agg(F.min("breakend").alias("a"), F.max("breakend").alias("b")).filter("a < b").select("a", "b")
    steps = pair if taken is None else pair.union(taken)
    found = G.components(steps, "a", "b")
    return ends.select("breakend", "variant").join(found, F.col("breakend") == F.col("node"), "left").select(F.coalesce("root", "breakend").alias("chain"), "breakend", "variant")

"""Haplotypes of a gene from fragments that hold several of its unlike places, and the alleles that agree with them.

Pairs of neighbouring places are counted by joins. Longer haplotypes are put together from the patterns of a gene's fragments, which are counted over all tasks first: a gene is one row of distinct patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fragments that evidence needs for each allele expected, alleles expected, fragments from which a combination seen once is taken out.
PER_ALLELE, EXPECTED, SINGLES = 7, 2, 40


def unlike_places(evidence: DataFrame, by: list[str]) -> DataFrame:
    """(by, locus, next, letters): places with more than one supported letter, and the next such place of the gene; evidence: (by, locus, letter)."""
    many = evidence.groupBy(*by, "locus").agg(F.array_sort(F.collect_set("letter")).alias("letters")).filter(F.size("letters") > 1)
    return many.withColumn("next", F.lead("locus").over(Window.partitionBy(*by).orderBy("locus")))


def _supported(fragments: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
    """The distinct (by, fragment, locus, letter) at unlike places with a supported letter; a fragment with two letters at a place has none there."""
    known = fragments.join(places, [*by, "locus"]).filter(F.array_contains("letters", F.col("letter"))).select(*by, "fragment", "locus", "letter")
    one = known.groupBy(*by, "fragment", "locus").agg(F.min("letter").alias("letter"), F.max("letter").alias("other"))
    return one.filter("letter = other").drop("other")


def phased_pairs(fragments: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """(by, locus, next, a, b, n): how many fragments (by, fragment, locus, letter) hold letters a and b at neighbouring unlike places."""
    places = unlike_places(evidence, by)
    own = _supported(fragments, places, by)
    first = own.join(places.select(*by, "locus", "next").filter("next IS NOT NULL"), [*by, "locus"]).withColumnRenamed("letter", "a")
    second = own.select(*by, "fragment", F.col("locus").alias("next"), F.col("letter").alias("b"))
    return first.join(second, [*by, "fragment", "next"]).groupBy(*by, "locus", "next", "a", "b").agg(F.count("*").alias("n"))


class Evidence:
    """Combinations of letters at places ``lo`` to ``hi`` (numbers of unlike places, both included), with their fragments."""

    def __init__(self, lo: int, hi: int, counts: dict[str, int]):
        self.lo, self.hi, self.counts = lo, hi, counts

    def total(self) -> int:
        return sum(self.counts.values())

    def tail(self) -> int:
        """The fewest places at the end that tell all combinations apart; head: at the begin."""
        return next(k for k in range(1, self.hi - self.lo + 2) if len({h[-k:] for h in self.counts}) == len(self.counts))

    def head(self) -> int:
        return next(k for k in range(1, self.hi - self.lo + 2) if len({h[:k] for h in self.counts}) == len(self.counts))


def _seen(patterns: list[tuple[str, int]], lo: int, hi: int, singles: int) -> Evidence:
    """What the patterns (a letter for each place, ``.`` for none) that hold all places lo to hi show; combinations seen once are left out of many."""
    counts: dict[str, int] = {}
    for p, n in patterns:
        part = p[lo : hi + 1]
        if "." not in part:
            counts[part] = counts.get(part, 0) + n
    if sum(counts.values()) >= singles:
        counts = {h: n for h, n in counts.items() if n > 1}
    return Evidence(lo, hi, counts)


def _fits(left: Evidence, right: Evidence) -> bool:
    """Whether both show the same combinations at the places that they share."""
    lo, hi = right.lo, left.hi
    return {h[lo - left.lo :] for h in left.counts} == {h[: hi - lo + 1] for h in right.counts}


def _combined(left: Evidence, right: Evidence) -> Evidence:
    shared = left.hi - right.lo + 1
    counts = {a + b[shared:]: min(n, m) for a, n in left.counts.items() for b, m in right.counts.items() if a[len(a) - shared :] == b[:shared]}
    return Evidence(left.lo, right.hi, counts)


def combined(patterns: list[tuple[str, int]], places: int, letters: list[set[str]], least: int, singles: int = SINGLES) -> list[Evidence]:
    """Haplotypes over runs of unlike places: neighbouring pairs first, then those that share a place are joined over fragments that hold the places that tell their combinations apart, the best supported first."""
    found = []
    for i in range(places - 1):
        pair = _seen(patterns, i, i + 1, singles)
        if pair.total() >= least and {h[0] for h in pair.counts} == letters[i] and {h[1] for h in pair.counts} == letters[i + 1]:
            found.append(pair)
    tried: set[tuple[int, int, int]] = set()
    while True:
        steps = [(-(x.total() + y.total()), x.lo, x, y) for x, y in zip(found, found[1:]) if x.hi == y.lo and (x.lo, x.hi, y.hi) not in tried]
        if not steps:
            return found
        _, _, x, y = min(steps, key=lambda s: s[:2])
        tried.add((x.lo, x.hi, y.hi))
        bridge = _seen(patterns, x.hi - x.tail() + 1, y.lo + y.head() - 1, singles)
        if bridge.total() >= least and _fits(x, bridge) and _fits(bridge, y):
            whole = _combined(_combined(x, bridge), y)
            if whole.total() >= least:
                k = found.index(x)
                found[k : k + 2] = [whole]


def phased_haplotypes(fragments: DataFrame, evidence: DataFrame, by: list[str], least: int = PER_ALLELE * EXPECTED, singles: int = SINGLES) -> DataFrame:
    """(by, first, last, loci, haplotype, n): letters at runs of unlike places that stand on one molecule, from fragments (by, fragment, locus, letter) and supported letters (by, locus, letter).

    A pair or a bridge needs ``least`` fragments; a combination that is seen once among ``singles`` or more is an error. Fragments with unsupported or two letters at a place don't hold it. Genes with fewer than two unlike places
    have no haplotypes.
    """
    places = unlike_places(evidence, by)
    numbered = places.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("locus")) - 1)
    own = _supported(fragments, places, by).join(numbered.select(*by, "locus", "k"), [*by, "locus"])
    size = places.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("locus", "letters"))).alias("places"))
    held = own.groupBy(*by, "fragment").agg(F.map_from_entries(F.collect_list(F.struct("k", "letter"))).alias("m")).join(size, by)
    pattern = F.array_join(F.transform(F.sequence(F.lit(0), F.size("places") - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit("."))), "")
    patterns = held.select(*by, pattern.alias("p")).groupBy(*by, "p").agg(F.count("*").alias("n")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("patterns")).join(size, by).filter(F.size("places") > 1)
    kinds = ", ".join(f"`{k}` {fragments.schema[k].dataType.simpleString()}" for k in by)
    locus = evidence.schema["locus"].dataType.simpleString()
    types = [patterns.schema[k].dataType for k in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                loci = [x["locus"] for x in row["places"]]
                for e in combined([(x["p"], x["n"]) for x in row["patterns"]], len(loci), [set(x["letters"]) for x in row["places"]], least, singles):
                    out += [(*[row[k] for k in by], loci[e.lo], loci[e.hi], loci[e.lo : e.hi + 1], h, n) for h, n in sorted(e.counts.items())]
            at = pa.int64() if locus == "bigint" else pa.int32()
            arrow = [*[to_arrow_type(t) for t in types], at, at, pa.list_(at), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(arrow)], [*by, "first", "last", "loci", "haplotype", "n"])

    return patterns.select(*by, "patterns", "places").mapInArrow(run, f"{kinds}, first {locus}, last {locus}, loci array<{locus}>, haplotype string, n long")


def agreeing_alleles(alleles: DataFrame, haplotypes: DataFrame, by: list[str], gene: str = "gene") -> DataFrame:
    """(by, allele): alleles (allele, gene, locus, letter) that have, for every run of places with haplotypes, one of them; ``*`` matches any letter, and a place that an allele lacks matches none. by holds the gene.

    With the gene alone as ``by``, genes without haplotypes keep all their alleles; with samples too, only genes of samples with haplotypes come out.
    """
    letters = haplotypes.select(*by, "first", "haplotype", F.posexplode("loci").alias("i", "locus")).withColumn("wanted", F.expr("substring(haplotype, i + 1, 1)"))
    names = alleles.select("allele", gene).distinct()
    # Sorted and never broadcast, as the places that ``explode`` makes are not in the planner's size of the alleles.
    runs = letters.join(names.hint("merge"), gene)
    met = runs.join(alleles.select("allele", gene, "locus", "letter").hint("merge"), ["allele", gene, "locus"], "left")
    wrong = F.coalesce((F.col("letter") != F.col("wanted")) & (F.col("letter") != "*"), F.lit(True))
    each = met.groupBy(*by, "allele", "first", "haplotype").agg(F.count_if(wrong).alias("wrong"))
    lost = each.groupBy(*by, "allele", "first").agg(F.min("wrong").alias("wrong")).filter("wrong > 0").select(*by, "allele").distinct()
    held = haplotypes.select(*by).distinct()
    every = held.join(names, gene) if len(by) > 1 else names
    return every.join(lost, [*by, "allele"], "left_anti").select(*by, "allele")

"""Structural variants: duplicates, neighbouring breakends, fusions, disruptions, panels of breakend pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as I


def duplicates(variants: DataFrame, ends: list[str], fragments: str, *ties: str) -> DataFrame:
    """The rows with ``duplicate``: of unfiltered variants with the same ends (nulls alike), all but the one with most fragments."""
    order = Window.partitionBy("filtered", *ends).orderBy(F.desc(fragments), *ties)
    return variants.withColumn("duplicate", ~F.col("filtered") & (F.row_number().over(order) > 1))


def pair_links(breakends: DataFrame, by: list[str], position: str, orientation: str, owner: str, least: int = 30) -> DataFrame:
    """(by, first, second, kind, distance) of consecutive breakends of different variants.

    DB where they face away from each other (-1 after +1 in order of position), unless the next pair is a nearer bridge; facing ones are TI, or an overlapping
    DB under ``least`` bases.
    """
    order = Window.partitionBy(*by).orderBy(position, owner, orientation)
    nxt = lambda c, n=1: F.lead(c, n).over(order)
    away = lambda a, b: (a == 1) & (b == -1)
    rows = breakends.withColumns({"__p1": nxt(position), "__o1": nxt(orientation), "__w1": nxt(owner), "__p2": nxt(position, 2), "__o2": nxt(orientation, 2), "__w2": nxt(owner, 2)})
    gap = F.col("__p1") - F.col(position)
    bridge = away(F.col(orientation), F.col("__o1"))
    nearer = away(F.col("__o1"), F.col("__o2")) & (F.col("__w1") != F.col("__w2")) & (F.col("__p2") - F.col("__p1") < gap)
    facing = (F.col(orientation) == -1) & (F.col("__o1") == 1)
    kind = F.when(bridge & ~F.coalesce(nearer, F.lit(False)), "DB").when(facing & (gap < least), "DB_OVERLAP").when(facing, "TI")
    out = rows.filter(F.col(owner) != F.col("__w1")).select(*by, F.col(owner).alias("first"), F.col("__w1").alias("second"), kind.alias("kind"), gap.alias("distance"))
    return out.filter("kind IS NOT NULL")


def foldbacks(breakends: DataFrame, by: list[str], position: str, orientation: str, owner: str) -> DataFrame:
    """(by, owner, start, end): consecutive breakends of one variant with the same orientation."""
    order = Window.partitionBy(*by).orderBy(position, owner, orientation)
    rows = breakends.withColumns({"__p": F.lead(position).over(order), "__o": F.lead(orientation).over(order), "__w": F.lead(owner).over(order)})
    return rows.filter((F.col("__w") == F.col(owner)) & (F.col("__o") == F.col(orientation))).select(*by, owner, F.col(position).alias("start"), F.col("__p").alias("end"))


def pair_panel(pairs: DataFrame, known: DataFrame, margin: int, bin_size: int = 1000) -> DataFrame:
    """The pairs (id, chr1, pos1, or1, chr2, pos2, or2) with ``samples``: most samples of a known pair with both ends within ``margin``, 0 without."""
    other = known.select("chr1", "or1", "chr2", "or2", F.col("pos1").alias("__a"), F.col("pos1").alias("__b"), F.col("pos2").alias("__c"), "samples")
    keyed = pairs.withColumn("__p", F.col("pos1"))
    found = I.range_join(keyed, other, ["chr1", "or1", "chr2", "or2"], ("pos1", "__p"), ("__a", "__b"), bin_size, slack=margin).filter(F.abs(F.col("pos2") - F.col("__c")) <= margin)
    best = found.groupBy("id").agg(F.max("samples").alias("samples"))
    return pairs.join(best, "id", "left").fillna(0, ["samples"])


def fusions(starts: DataFrame, ends: DataFrame, known: DataFrame, priority: list[Column]) -> DataFrame:
    """Best fusion of each variant from its annotations (sv, gene, transcript, upstream, phase, coding, ...): an upstream with a downstream one of another gene.

    starts and ends are joined by variant, so the product is of one variant's few annotations. Known pairs (five, three) come first, then the given order.
    """
    a = starts.withColumnsRenamed({c: f"up_{c}" for c in starts.columns if c != "sv"})
    b = ends.withColumnsRenamed({c: f"down_{c}" for c in ends.columns if c != "sv"})
    both = a.join(b, "sv").filter("up_upstream AND NOT down_upstream AND up_gene != down_gene")
    pairs = known.select(F.col("five").alias("up_gene"), F.col("three").alias("down_gene"), F.lit(True).alias("known"))
    marked = both.join(pairs, ["up_gene", "down_gene"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    usable = marked.filter("known OR (up_coding AND down_coding)").withColumn("phased", F.col("up_phase") == F.col("down_phase"))
    order = Window.partitionBy("sv").orderBy(F.desc("known"), F.desc("phased"), *priority)
    return usable.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def disrupted(breakends: DataFrame) -> DataFrame:
    """(transcript, sv): transcripts that a variant disrupts, from breakends (sv, transcript, intron): all but those whose two breakends lie in one intron."""
    n = breakends.groupBy("sv", "transcript").agg(F.count("*").alias("n"), F.count_distinct("intron").alias("introns"), F.count_if(F.col("intron").isNull()).alias("exonic"))
    return n.filter("NOT (n = 2 AND introns = 1 AND exonic = 0)").select("transcript", "sv")


def junctions(reads: DataFrame, by: list[str], position: str, orientation: str, least: int, margin: int) -> DataFrame:
    """(by, position, orientation, support, nearby): clipped positions with enough exact reads, and reads of the same side within ``margin``."""
    exact = reads.groupBy(*by, position, orientation).agg(F.count("*").alias("support"))
    order = Window.partitionBy(*by, orientation).orderBy(position).rangeBetween(-margin, margin)
    return exact.withColumn("nearby", F.sum("support").over(order)).filter(F.col("support") >= least)

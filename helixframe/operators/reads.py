"""Reads: fragments, duplicates, evidence, phase sets, microsatellites."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(reads: DataFrame, ends: list[str], name: str, quality: str) -> DataFrame:
    """The reads with ``group_size`` and ``primary``: fragments of equal ends are one group, its best by quality (then name) is primary."""
    group = Window.partitionBy(*ends)
    return reads.withColumns({"group_size": F.count("*").over(group), "primary": F.row_number().over(group.orderBy(F.desc(quality), name)) == 1})


def mates(first: DataFrame, second: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Reads with their mates' columns (``mate_``); a read without one has nulls, a mate alone is kept too."""
    return first.select(name, *columns).join(second.select(name, *[F.col(c).alias(f"mate_{c}") for c in columns]), name, "full_outer")


def evidence(reads: DataFrame, sites: DataFrame, by: list[str], position: str, base: Column, least_quality: int) -> DataFrame:
    """(by, position, ref, alt, depth, ref_support, alt_support, qual) at known sites; bases below the quality count in depth only."""
    joined = sites.join(reads.withColumn("__base", base), [*by, position], "left")
    good = F.col("quality") >= least_quality
    return joined.groupBy(*by, position, "ref", "alt").agg(
        F.count("__base").alias("depth"), F.count_if(good & (F.col("__base") == F.col("ref"))).alias("ref_support"), F.count_if(good & (F.col("__base") == F.col("alt"))).alias("alt_support"),
        F.coalesce(F.sum(F.when(good & (F.col("__base") == F.col("alt")), F.col("quality"))), F.lit(0)).alias("qual"),
    )


def phase_sets(carried: DataFrame, region: str, variants: str, least: int) -> DataFrame:
    """(region, set, support): sets of variants that reads carry together, those inside a larger one added to it, with ``least`` reads or more.

    Reads are first counted by their set, so what a region's function sees are distinct sets.
    """
    counted = carried.select(region, F.array_sort(F.array_distinct(variants)).alias("set")).filter(F.size("set") > 0).groupBy(region, "set").agg(F.count("*").alias("n"))
    kind, item = counted.schema[region].dataType.simpleString(), counted.schema["set"].dataType.elementType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = sorted(((frozenset(s), int(n)) for s, n in zip(rows["set"], rows["n"])), key=lambda x: (-len(x[0]), sorted(x[0])))
        kept: list[list] = []
        for s, n in sets:
            over = [k for k in kept if s < k[0]]
            if len(over) == 1:
                over[0][1] += n
            elif not over:
                kept.append([s, n])
        good = [(sorted(s), n) for s, n in kept if n >= least]
        return pd.DataFrame({region: [rows[region].iloc[0]] * len(good), "set": [s for s, _ in good], "support": [n for _, n in good]})

    return counted.groupBy(region).applyInPandas(run, f"{region} {kind}, set array<{item}>, support long")


def jitter_table(repeats: DataFrame, unit: str, count: str, jitter: str, widest: int = 10) -> DataFrame:
    """(unit, count, reads by jitter -widest to widest as columns, error_rate): error rate is the mean distance."""
    j = F.col(jitter)
    columns = [F.count_if(j == k).alias(f"j{k}".replace("-", "m")) for k in range(-widest, widest + 1)]
    return repeats.groupBy(unit, count).agg(*columns, (F.sum(F.abs(j)) / F.count("*")).alias("error_rate"))


def greedy_dedup(rows: DataFrame, by: str, start: str, end: str, score: str, ident: str) -> DataFrame:
    """The rows with ``kept``: within a phase set, from the best score on (ties by id), a variant that overlaps a kept one is dropped.

    Only variants that overlap, directly or over others, concern each other, so a task holds one such chain and not a phase set.
    """
    from . import intervals as I

    kind = rows.schema[by].dataType.simpleString()
    own = rows.schema[ident].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, chain, spans = [], None, []
        for r in group.sort_values([by, "__run", score, ident], ascending=[True, True, False, True]).itertuples(index=False, name=None):
            key, a, b, _, name, number = r
            if (key, number) != chain:
                chain, spans = (key, number), []
            keep = all(b < x or a > y for x, y in spans)
            if keep:
                spans.append((a, b))
            out.append((key, name, keep))
        return pd.DataFrame(out, columns=[by, ident, "kept"])

    # Chains are dealt to as many groups as there are shuffle partitions; a call for each of them would cost more than the work.
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = I.chained(rows.select(by, start, end, score, ident), [by], start, end).withColumn("__g", F.pmod(F.xxhash64(by, "__run"), F.lit(many)))
    verdict = linked.select(by, start, end, score, ident, "__run", "__g").groupBy("__g").applyInPandas(lambda group: run(group.drop(columns="__g")), f"{by} {kind}, {ident} {own}, kept boolean")
    return rows.join(verdict, [by, ident])


def expected_rates(transcripts: DataFrame, lengths: list[int]) -> DataFrame:
    """(members, length, n): start positions of fragments of each length by the set of transcripts (id, start, end) of one gene that hold them whole."""
    sizes = transcripts.sparkSession.createDataFrame([(n,) for n in lengths], "length long")
    spans = transcripts.join(F.broadcast(sizes), F.col("end") - F.col("start") + 1 >= F.col("length"))
    starts = spans.select("gene", "id", "length", F.explode(F.sequence(F.col("start"), F.col("end") - F.col("length") + 1)).alias("p"))
    return starts.groupBy("gene", "length", "p").agg(F.array_sort(F.collect_set("id")).alias("members")).groupBy("gene", "members", "length").agg(F.count("*").alias("n"))

"""Filters, lookups and deduplication of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def filter_names(tests: dict[str, Column]) -> Column:
    """The names of all tests that hold, joined by ``;``, or PASS. A test that is null does not hold."""
    found = F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))
    return F.when(F.size(found) == 0, "PASS").otherwise(F.array_join(found, ";"))


def first_failure(tests: dict[str, Column]) -> Column:
    """The name of the first test that holds, else null."""
    out = F.lit(None).cast("string")
    for n, t in reversed(tests.items()):
        out = F.when(t, n).otherwise(out)
    return out


def with_tier(rows: DataFrame, tiers: DataFrame, tier: str, fallback: str) -> DataFrame:
    """Join the threshold table by tier; a tier that it lacks takes the row of ``fallback``. The table is a handful of fixed rows."""
    known = [r[0] for r in tiers.select(tier).collect()]
    key = F.when(F.col(tier).isin(known), F.col(tier)).otherwise(F.lit(fallback))
    return rows.withColumn("__tier", key).join(F.broadcast(tiers.withColumnRenamed(tier, "__tier")), "__tier", "left").drop("__tier")


def pon(evidence: DataFrame, keys: list[str], sample: str, reads: str, least: int = 1) -> DataFrame:
    """(keys, samples, max_reads, total_reads) of variants seen in at least ``least`` samples."""
    return evidence.groupBy(*keys).agg(F.count_distinct(sample).alias("samples"), F.max(reads).alias("max_reads"), F.sum(reads).alias("total_reads")).filter(F.col("samples") >= least)


def pon_combined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Panels of several runs as one: samples and reads add up."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(F.sum("samples").alias("samples"), F.max("max_reads").alias("max_reads"), F.sum("total_reads").alias("total_reads"))


def pon_filtered(rows: DataFrame, panel: DataFrame, keys: list[str], tiers: DataFrame, tier: str = "tier", fallback: str = "UNKNOWN") -> DataFrame:
    """The rows with samples, max_reads and ``pon``: true where both reach the limits (min_samples, min_reads) of the row's tier."""
    found = rows.join(panel.select(*keys, "samples", "max_reads"), keys, "left")
    hit = (F.col("samples") >= F.col("min_samples")) & (F.col("max_reads") >= F.col("min_reads"))
    return with_tier(found, tiers, tier, fallback).withColumn("pon", F.coalesce(hit, F.lit(False))).drop("min_samples", "min_reads")


def best_per(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which should leave no ties."""
    return top_per(rows, by, 1, *order)


def top_per(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def deduplicated(rows: DataFrame, by: list[str], qual: str, sets: str, *ties: str) -> DataFrame:
    """One row of each key, that of the highest quality (ties by the columns given), with the ``sets`` values of all its duplicates, sorted."""
    best = F.max(F.struct(F.col(qual).alias("__q"), F.struct(*[F.col(c) for c in ties]).alias("__t"))).alias("__best")
    merged = rows.groupBy(*by).agg(best, F.array_sort(F.collect_set(sets)).alias(sets))
    return merged.select(*by, F.col("__best.__q").alias(qual), *[F.col(f"__best.__t.{c}").alias(c) for c in ties], sets)


def rescued(rows: DataFrame, phase_sets: str, passes: Column) -> DataFrame:
    """Rows that pass, and those that share a phase set with one that does."""
    good = rows.filter(passes).select(F.explode(phase_sets).alias("__set")).distinct()
    marked = rows.withColumn("__id", F.struct(*[c for c in rows.columns]))
    kept = marked.select("__id", F.explode(phase_sets).alias("__set")).join(good, "__set", "left_semi").select(F.col("__id").alias("__kept")).distinct()
    return rows.filter(passes).unionByName(marked.filter(~passes).join(kept, F.col("__id") == F.col("__kept"), "left_semi").drop("__id"))


def every_nth(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Every ceil(n / most)-th row in the given order, the first one included.

    Ranks come from a range partitioning, written once, and the counts of its parts, so no task holds all rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part, nth = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counted = dealt.withColumns({"__part": part, "__nth": nth})
    sizes = counted.groupBy("__part").count().collect()  # a row for each partition
    total = sum(r["count"] for r in sizes)
    step = max(1, -(-total // most))
    before, run = [], 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        before.append((r["__part"], run))
        run += r["count"]
    starts = spark.createDataFrame(before, "__part long, __before long")
    return counted.join(F.broadcast(starts), "__part").filter((F.col("__before") + F.col("__nth")) % step == 0).drop("__id", "__part", "__nth", "__before")


#: Fixed order of contigs.
CONTIGS = [*[str(i) for i in range(1, 23)], "X", "Y", "MT"]


def contig_rank(contig: Column) -> Column:
    """1 to 25 for the human contigs in either spelling, else null."""
    bare = F.regexp_replace(F.regexp_replace(contig, "^chr", ""), "^M$", "MT")
    return F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CONTIGS, 1) for x in (c, i)]), bare)

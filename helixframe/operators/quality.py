"""Quality control, enrichments and cohort summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import intervals as I
from .ordered import aggregated


def status(value: Column, warn: float | None, fail: float | None, high_is_bad: bool = True) -> Column:
    """PASS, WARN or FAIL by thresholds; a limit that is None never applies, a null value gives null."""
    beyond = (lambda x: value > x) if high_is_bad else (lambda x: value < x)
    out = F.lit("PASS")
    if warn is not None:
        out = F.when(beyond(warn), "WARN").otherwise(out)
    if fail is not None:
        out = F.when(beyond(fail), "FAIL").otherwise(out)
    return F.when(value.isNotNull(), out)


def statuses(rows: DataFrame, thresholds: list[tuple[str, float | None, float | None, bool]], key: str) -> DataFrame:
    """(key, feature, value, status) in long form, by (feature, warn, fail, high is bad)."""
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"), status(F.col(n), w, f, h).alias("status")) for n, w, f, h in thresholds])
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.*")


def worst(rows: DataFrame, key: str, column: str = "status") -> DataFrame:
    """(key, status): the worst of a key's statuses."""
    rank = F.when(F.col(column) == "FAIL", 2).when(F.col(column) == "WARN", 1).otherwise(0)
    top = rows.groupBy(key).agg(F.max(rank).alias("r"))
    return top.select(key, F.when(F.col("r") == 2, "FAIL").when(F.col("r") == 1, "WARN").otherwise("PASS").alias("status"))


def whole_genome_duplication(segments: DataFrame, sample: str, chromosome: str, major: str, weight: str, least: int = 11, copies: float = 1.5, order: list[str] | None = None) -> DataFrame:
    """(sample, duplicated): whether enough chromosomes have a weighted mean major-allele copy number of ``copies`` or more; with an order, the means' sums are added up in it."""
    total, weights = F.sum(F.col(major) * F.col(weight)), F.sum(weight)
    both = segments.groupBy(sample, chromosome).agg(total.alias("t"), weights.alias("u")) if order is None else aggregated(segments, [sample, chromosome], order, t=total, u=weights)
    mean = both.withColumn("m", F.col("t") / F.col("u"))
    return mean.groupBy(sample).agg((F.count_if(F.col("m") >= copies) >= least).alias("duplicated"))


def polyclonal_share(segments: DataFrame, sample: str, copy_number: str, weight: str, away: float = 0.25) -> DataFrame:
    """(sample, share): weighted share of segments whose copy number is further than ``away`` from a whole one."""
    far = F.abs(F.col(copy_number) - F.floor(F.col(copy_number) + 0.5)) > away
    return segments.groupBy(sample).agg((F.sum(F.when(far, F.col(weight)).otherwise(0)) / F.sum(weight)).alias("share"))


def without_support(segments: DataFrame, breakends: DataFrame, keys: list[str], start: str) -> DataFrame:
    """Segments whose start no breakend supports, and which are not a key's first."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(start))
    later = segments.withColumn("__n", first).filter("__n > 1").drop("__n")
    return later.join(breakends.select(*keys, start).distinct(), [*keys, start], "left_anti")


def split_at(segments: DataFrame, excluded: DataFrame, by: list[str], start: str, end: str, ident: str, bin_size: int) -> DataFrame:
    """(ident, by, start, end, excluded): segments cut at excluded spans, with the parts inside marked."""
    cover = stored(I.merged(excluded, by, start, end), "cover")
    outside = I.subtracted(segments, cover, by, start, end, bin_size, ident, apart=True).withColumn("excluded", F.lit(False))
    c = cover.select(*by, F.col(start).alias("__c"), F.col(end).alias("__d"))
    inside = I.range_join(segments.select(ident, *by, start, end), c, by, (start, end), ("__c", "__d"), bin_size)
    inside = inside.select(ident, *by, F.greatest(start, "__c").alias(start), F.least(end, "__d").alias(end), F.lit(True).alias("excluded"))
    return outside.unionByName(inside)


def recurrent_sites(rows: DataFrame, site: list[str], sample: str, suspicious: Column, share: float, least: int) -> DataFrame:
    """(site, samples, suspicious): sites that are suspicious in at least ``share`` of ``least`` samples or more."""
    n = rows.groupBy(*site).agg(F.count_distinct(sample).alias("samples"), F.count_distinct(F.when(suspicious, F.col(sample))).alias("suspicious"))
    return n.filter((F.col("samples") >= least) & (F.col("suspicious") >= share * F.col("samples")))


def incomplete_fragments(reads: DataFrame, name: str, flags: str) -> DataFrame:
    """(name, n, problem): fragments whose primary reads are not exactly a first and a second of a pair."""
    f = F.col(flags)
    bit = lambda b: f.bitwiseAND(F.lit(b)) != 0
    primary = ~bit(0x100) & ~bit(0x800)
    n = reads.groupBy(name).agg(F.count("*").alias("n"), F.count_if(primary & bit(0x40)).alias("a"), F.count_if(primary & bit(0x80)).alias("b"), F.max(bit(0x1)).alias("paired"), F.count_if(primary).alias("p"))
    problem = F.when(~F.col("paired") & (F.col("p") != 1), "NOT_ONE").when(F.col("paired") & (F.col("a") != 1), "FIRST").when(F.col("paired") & (F.col("b") != 1), "SECOND")
    return n.select(name, "n", problem.alias("problem")).filter("problem IS NOT NULL")


def tier(hotspot: Column, panel: Column, high_confidence: Column) -> Column:
    """HOTSPOT, PANEL, HIGH_CONFIDENCE or LOW_CONFIDENCE: the first that holds."""
    return F.when(hotspot, "HOTSPOT").when(panel, "PANEL").when(high_confidence, "HIGH_CONFIDENCE").otherwise("LOW_CONFIDENCE")


def appended(variants: DataFrame, evidence: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """Existing variants with a further sample's depth and support; zeros where it has none."""
    new = evidence.select(*keys, F.col("depth").alias(f"{sample}_depth"), F.col("support").alias(f"{sample}_support"))
    return variants.join(new, keys, "left").fillna(0, [f"{sample}_depth", f"{sample}_support"])


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(class, n, predicted, correct, recall, precision)."""
    cells = rows.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("a").alias("class"), F.col("n").alias("na"), F.lit(0).cast("long").alias("np"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("ok")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("na"), F.col("n").alias("np"), F.lit(0).cast("long").alias("ok")))
    s = cells.select(F.explode(sides).alias("s")).groupBy("s.class").agg(F.sum("s.na").alias("n"), F.sum("s.np").alias("predicted"), F.sum("s.ok").alias("correct"))
    return s.withColumns({"recall": F.when(F.col("n") > 0, F.col("correct") / F.col("n")), "precision": F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted"))})


#: Pairs of a task, so that a task's memory doesn't grow with the hierarchy.
TASK_ROWS = 500_000


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(term, ancestor): all ancestors of every term of a hierarchy, of cycles too; the covered distance doubles with each round, which is written to the shared folder.

    Distances below a power of two are known; the next ones are those followed by a step of exactly that power. So a pair comes once for each path between its terms and not once for each place where a path can be cut.
    """
    known = step = stored(edges.select(F.col(child).alias("term"), F.col(parent).alias("ancestor")).distinct(), "ancestors")
    default = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = known.count()
    while True:
        tasks = max(default, -(-2 * n // TASK_ROWS))
        then = step.select(F.col("term").alias("__at"), F.col("ancestor").alias("__next")).repartition(tasks, "__at")
        follow = lambda rows: rows.repartition(tasks, "ancestor").join(then.hint("merge"), F.col("ancestor") == F.col("__at")).select("term", F.col("__next").alias("ancestor"))  # noqa: B023, E731
        further = stored(known.union(follow(known)).repartition(tasks, "term", "ancestor").distinct(), "ancestors")
        step = stored(follow(step).repartition(tasks, "term", "ancestor").distinct(), "steps")
        known = further
        if (m := known.count()) == n:
            return known
        n = m


def repeat_sites(chunks: DataFrame, contig: str, chunk: str, bases: str, size: int, unit: int, least: int) -> DataFrame:
    """(contig, position, repeat): runs of at least ``least`` repeats of a unit within the chunks of a reference; positions from 1.

    Runs are found within chunks that carry the first bases of the next one, so one across a border is found in the chunk where it begins, up to the carried length.
    """
    order = Window.partitionBy(contig).orderBy(chunk)
    carried = chunks.withColumn("__b", F.concat(bases, F.coalesce(F.substring(F.lead(bases).over(order), 1, 20 * unit), F.lit(""))))
    pattern = f"(([ACGT]{{{unit}}})\\2{{{least - 1},}})"
    parts = F.array(F.struct(F.regexp_extract_all("__b", F.lit(pattern), F.lit(1)).alias("hits"), F.split("__b", pattern, -1).alias("gaps")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<p:int,r:string>>").alias("out"))

    def places(p: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            a = s["at"] + F.length(F.get(p["gaps"], i))
            hit = F.get(p["hits"], i)
            return F.struct((a + F.length(hit)).alias("at"), F.concat(s["out"], F.array(F.struct(a.alias("p"), hit.alias("r")))).alias("out"))

        return F.aggregate(F.when(F.size(p["hits"]) > 0, F.sequence(F.lit(0), F.size(p["hits"]) - 1)).otherwise(F.array().cast("array<int>")), zero, step, lambda s: s["out"])

    found = carried.select(contig, chunk, F.explode(F.get(F.transform(parts, places), F.lit(0))).alias("x"))
    return found.filter(F.col("x.p") < size).select(contig, (F.col(chunk) * size + F.col("x.p") + 1).alias("position"), F.col("x.r").alias("repeat"))


def new_ids(samples: DataFrame, known: DataFrame, sample: str, salt: str) -> DataFrame:
    """(hash, id): known ids stay, new hashes get the next numbers in the order of their hashes."""
    hashed = samples.select(F.sha2(F.concat(F.col(sample).cast("string"), F.lit(salt)), 256).alias("hash")).distinct()
    fresh = hashed.join(known, "hash", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    spark = samples.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(fresh.repartitionByRange(parts, "hash").sortWithinPartitions("hash").withColumn("__id", F.monotonically_increasing_id()), "fresh")
    dealt = dealt.withColumns({"__part": F.shiftright("__id", 33), "__nth": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes, run, before = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect()), 0, []
    for p, n in sizes:  # a row for each partition
        before.append((p, run))
        run += n
    starts = spark.createDataFrame(before, "__part long, __before long")
    numbered = dealt.join(F.broadcast(starts), "__part").crossJoin(F.broadcast(top)).select("hash", (F.col("__top") + F.col("__before") + F.col("__nth") + 1).alias("id"))
    return known.select("hash", "id").unionByName(numbered)

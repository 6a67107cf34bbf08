"""Joins and set operations on intervals. Positions are 1-based and ends inclusive.

Range joins deal both sides by key and bin, so they shuffle on equal keys and never compare all pairs; a pair is emitted in the first
bin that both sides share, so no distinct is needed. Scans in order (merging, islands, coverage, nearest) sort buckets of positions and carry over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from . import buckets as B

#: Positions in a bucket of an ordered scan.
BUCKET = 1 << 16


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether a holds all of b."""
    return (a_start <= b_start) & (b_end <= a_end)


def _bin(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("long")


def range_join(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_size: int, how: str = "inner", slack: int = 0) -> DataFrame:
    """Pairs that agree in ``by`` and whose spans overlap, or come within ``slack``.

    how: inner, or left (unmatched left rows with nulls). Column names must differ but for ``by``; the larger side should be left, whose
    spans are usually points. The join is sorted and never broadcast: the planner sizes a side by its columns and not by the rows that ``explode`` makes of it, here or in the caller.
    """
    a, b, c, d = F.col(left_span[0]), F.col(left_span[1]), F.col(right_span[0]) - slack, F.col(right_span[1]) + slack
    binned = left.withColumn("__bin", F.explode(F.sequence(_bin(a, bin_size), _bin(b, bin_size))))
    others = right.withColumn("__bin", F.explode(F.sequence(_bin(c, bin_size), _bin(d, bin_size))))
    first = F.greatest(_bin(a, bin_size), _bin(c, bin_size)) == F.col("__bin")
    found = binned.join(others.hint("merge"), [*by, "__bin"]).filter(overlaps(a, b, c, d) & first).drop("__bin")
    if how == "inner":
        return found
    extra = [x for x in right.columns if x not in by]
    keys = left.columns
    matched = found.select(*keys).distinct()
    alone = left.alias("l").join(matched.alias("m"), [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left_anti")
    return found.select(*keys, *extra).unionByName(alone.select(*keys, *[F.lit(None).cast(right.schema[x].dataType).alias(x) for x in extra]))


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], bucket: int | None = None, tolerance: int | None = None, tasks: int | None = None) -> DataFrame:
    """The rows of left with ``values`` of the last row of right at or before it; null where there is none, or none within ``tolerance``. Of rows of right at one position, that of the largest values, compared in their order, holds.

    With ``bucket`` (a width in units of the positions), one key's rows are dealt over many tasks: the last row of every bucket is carried on to the next ones
    by a window over buckets, and only rows of one bucket are sorted together. tasks: how many sort them; without it, as many as the session has for a shuffle, whose memory then grows with the rows.
    """
    item = F.struct(F.col(right_on).alias("__at"), *values)
    empty = F.lit(None).cast(right.select(item.alias("x")).schema["x"].dataType)
    marked = left.withColumns({"__pos": F.col(left_on), "__item": empty, "__row": F.lit(True)})
    keyed = right.select(*by, F.col(right_on).alias("__pos"), item.alias("__item"), F.lit(False).alias("__row"))
    both = marked.unionByName(keyed, allowMissingColumns=True)
    keys = list(by)
    if bucket:
        dealt = lambda rows, *keys: rows.repartition(tasks, *keys) if tasks else rows
        both = dealt(both.withColumn("__bucket", _bin(F.col("__pos"), bucket)), *by, "__bucket")
        last = dealt(keyed.withColumn("__bucket", _bin(F.col("__pos"), bucket)), *by, "__bucket").groupBy(*by, "__bucket").agg(F.max("__item").alias("__last"))
        spans = both.select(*by, "__bucket").distinct().join(last, [*by, "__bucket"], "left")
        before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = dealt(spans, *by).withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).drop("__last")
        both = both.join(dealt(carried, *by, "__bucket"), [*by, "__bucket"])
        keys.append("__bucket")
    else:
        both = both.withColumn("__carried", empty)
    order = Window.partitionBy(*keys).orderBy("__pos", "__row", "__item").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.coalesce(F.last("__item", ignorenulls=True).over(order), F.col("__carried"))).filter("__row")
    if tolerance is not None:
        found = found.withColumn("__found", F.when(F.col("__pos") - F.col("__found.__at") <= tolerance, F.col("__found")))
    return found.select(*left.columns, *[F.col(f"__found.{v}").alias(v) for v in values])


def _runs(rows: DataFrame, by: list[str], new: Column, *order: Column) -> DataFrame:
    """Dealt rows with ``__run``: how many rows up to each, itself included and equals too, begin something new."""
    # Written, as it is read for the counts and for the rows: a plan of several such steps would double with each.
    marked = stored(rows.withColumn("__new", F.when(new, 1).otherwise(0)), "runs")
    both = B.carried(marked, by, {"__runs": (F.sum("__new"), "sum")})
    here = F.sum("__new").over(B.within(by).orderBy(*order).rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__run", F.coalesce("__runs", F.lit(0)) + here).drop("__new", "__runs")


def merged(spans: DataFrame, by: list[str], start: str, end: str, gap: int = 0, bucket: int = BUCKET) -> DataFrame:
    """(by, start, end, n): overlapping spans, adjacent ones, and those up to ``gap`` positions apart, as one. Spans are sorted by buckets of ``bucket`` positions of their starts."""
    return chained(spans, by, start, end, gap, bucket).groupBy(*by, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__run")


def chained(spans: DataFrame, by: list[str], start: str, end: str, gap: int = 0, bucket: int = BUCKET) -> DataFrame:
    """The spans with ``__run``, a number for each stretch that they cover without a gap of more than ``gap`` positions."""
    rows = B.carried(B.dealt(spans, start, bucket), by, {"__far": (F.max(end), "max")})
    order = B.within(by).orderBy(start, end)
    reach = F.greatest(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__far"))
    island = _runs(rows.withColumn("__reach", reach), by, F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + 1 + gap), F.col(start))
    return island.select(*spans.columns, "__run")


def subtracted(targets: DataFrame, covered: DataFrame, by: list[str], start: str, end: str, bin_size: int, id_col: str, bucket: int = BUCKET, apart: bool = False) -> DataFrame:
    """(id_col, by, start, end): the parts of each target that no covered span holds. ``id_col`` names a target. apart: the covered spans are merged already.

    The gaps between a key's merged spans meet the targets by bins; what lies before the first span or behind the last comes from one row for each key.
    """
    cover = B.dealt(covered if apart else stored(merged(covered, by, start, end, 0, bucket), "cover"), start, bucket)
    rows = B.carried(cover, by, {"__next": (F.min(start), "last")}, behind=True)
    follows = F.coalesce(F.lead(start).over(B.within(by).orderBy(start)), F.col("__next"))
    gaps = rows.select(*by, (F.col(end) + 1).alias("__c"), (follows - 1).alias("__d")).filter("__c <= __d")
    own = targets.select(id_col, *by, start, end)
    inside = range_join(own, gaps, by, (start, end), ("__c", "__d"), bin_size).select(id_col, *by, F.greatest(start, "__c").alias("__a"), F.least(end, "__d").alias("__b"))
    ends = own.join(cover.groupBy(*by).agg(F.min(start).alias("__first"), F.max(end).alias("__last")), by, "left")
    head = ends.select(id_col, *by, F.col(start).alias("__a"), F.least(end, F.col("__first") - 1).alias("__b"))
    tail = ends.filter("__last IS NOT NULL").select(id_col, *by, F.greatest(start, F.col("__last") + 1).alias("__a"), F.col(end).alias("__b"))
    return inside.union(head).union(tail).filter("__a <= __b").select(id_col, *by, F.col("__a").alias(start), F.col("__b").alias(end))


def islands(rows: DataFrame, by: list[str], position: str, gap: int, bucket: int | None = None) -> DataFrame:
    """The rows with ``island``, numbered from 1 within ``by``: a new one begins where the step from the row before exceeds ``gap``."""
    dealt = B.carried(B.dealt(rows, position, bucket or max(1, 64 * gap)), by, {"__before": (F.max(position), "last")})
    step = F.col(position) - F.coalesce(F.lag(position).over(B.within(by).orderBy(position)), F.col("__before"))
    marked = _runs(dealt.withColumn("__step", step), by, F.col("__step") > gap, F.col(position))
    return marked.withColumn("island", (F.col("__run") + 1).cast("long")).select(*rows.columns, "island")


def coverage(spans: DataFrame, by: list[str], start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """(by, start, end, depth): stretches of equal depth, as sums of steps up at starts and down behind ends."""
    steps = spans.select(*by, F.explode(F.array(F.struct(F.col(start).alias("p"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("p"), F.lit(-1).alias("d")))).alias("s"))
    at = stored(steps.groupBy(*by, "s.p").agg(F.sum("s.d").alias("d")).filter("d != 0"), "steps")
    rows = B.carried(B.dealt(at, "p", bucket), by, {"__depth": (F.sum("d"), "sum")})
    rows = B.carried(rows, by, {"__next": (F.min("p"), "last")}, behind=True)
    order = B.within(by).orderBy("p")
    depth = F.coalesce("__depth", F.lit(0)) + F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    follows = F.coalesce(F.lead("p").over(order), F.col("__next"))
    return rows.select(*by, F.col("p").alias(start), (follows - 1).alias(end), depth.alias("depth")).filter("depth > 0")


def high_depth(spans: DataFrame, by: list[str], start: str, end: str, least: int, gap: int, bucket: int = BUCKET) -> DataFrame:
    """(by, start, end, first_depth, max_depth): regions of at least ``least`` depth; a region closes after more than ``gap`` positions below it."""
    deep = stored(coverage(spans, by, start, end, bucket).filter(F.col("depth") >= least), "deep")
    rows = B.carried(B.dealt(deep, start, bucket), by, {"__before": (F.max(end), "max")})
    step = F.col(start) - F.coalesce(F.lag(end).over(B.within(by).orderBy(start)), F.col("__before")) - 1
    marked = _runs(rows.withColumn("__step", step), by, F.col("__step") > gap, F.col(start))
    return marked.groupBy(*by, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.min_by("depth", start).alias("first_depth"), F.max("depth").alias("max_depth")).drop("__run")


def _sided(rows: DataFrame, by: list[str], position: str, owner: str, behind: bool, name: str) -> DataFrame:
    """Dealt rows with ``name``: the position of the nearest row before (or behind) that another owner has.

    Buckets are represented by two rows each, the last one and the last of another owner than that; scanned in order, they tell what each bucket begins with.
    """
    way = F.desc if behind else F.asc
    most = F.min if behind else F.max
    order = B.within(by).orderBy(way(position), way(owner))
    rows = rows.withColumn("__changed", F.when(~F.lag(owner).over(order).eqNullSafe(F.col(owner)), F.lag(position).over(order)))
    here = F.last("__changed", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    keys = [*by, B.BUCKET]
    point = F.struct(F.col(position).alias("p"), F.col(owner).alias("o"))
    ends = rows.groupBy(*keys, owner).agg(most(position).alias(position)).groupBy(*keys).agg(most(point).alias("one"), F.collect_list(point).alias("every"))
    # The other owners' last rows come from one row for each owner of a bucket; those of the last row's owner are passed over.
    other = F.filter("every", lambda x: ~x["o"].eqNullSafe(F.col("one.o")))
    two = F.array_min(other) if behind else F.array_max(other)
    line = Window.partitionBy(*by).orderBy(way(B.BUCKET))
    state = ends.select(*keys, "one", two["p"].alias("two"))
    # What stands before the bucket: its last row, and the last row of another owner than that one, found by passing over buckets of that owner alone.
    state = state.withColumn("__switch", F.when(F.col("two").isNotNull(), F.col("two")).when(~F.lag("one.o").over(line).eqNullSafe(F.col("one.o")), F.lag("one.p").over(line)))
    state = state.withColumn("two", F.last("__switch", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    before = state.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lag("one").over(line).alias("__one"), F.lag("two").over(line).alias("__two"))
    joined = rows.withColumn("__here", here).join(before, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left")
    far = F.when(~F.col("__one.o").eqNullSafe(F.col(owner)), F.col("__one.p")).otherwise(F.col("__two"))
    return joined.withColumn(name, F.coalesce("__here", far)).drop("__changed", "__here", "__one", "__two", *[f"__k{i}" for i in range(len(keys))])


def nearest(rows: DataFrame, by: list[str], position: str, owner: str, bucket: int = BUCKET) -> DataFrame:
    """The rows with ``nearest``: the distance to the closest row before or behind that another ``owner`` has; null if there is none.

    Rows are taken in the order of position and owner. Rows of one owner at a stretch are skipped by carrying the last position of the owner before, over buckets too.
    """
    both = _sided(_sided(B.dealt(rows, position, bucket), by, position, owner, False, "__b"), by, position, owner, True, "__a")
    return both.select(*rows.columns, F.least(F.col(position) - F.col("__b"), F.col("__a") - F.col(position)).alias("nearest"))

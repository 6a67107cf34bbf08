"""Read depth in fixed windows and its normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import buckets as B

WINDOW = 1000
#: Fixed values of the GC range: the lower bound is exclusive, the upper inclusive.
GC_LEAST, GC_MOST = 0.24, 0.68


def window_depth(reads: DataFrame, by: list[str], start: str, length: str, gc_bases: str, size: int = WINDOW, ends: DataFrame | None = None) -> DataFrame:
    """(by, window, depth, gc): every read gives each window the bases that lie in it, and GC bases in proportion.

    depth is bases / size, gc the share of GC bases. ends: (by, end); windows that reach beyond it are dropped.
    """
    last = F.col(start) + F.col(length) - 1
    dealt = reads.withColumn("window", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(last / size))))
    inside = F.least(last, (F.col("window") + 1) * size - 1) - F.greatest(F.col(start), F.col("window") * size) + 1
    parts = dealt.select(*by, "window", inside.alias("__n"), (F.col(gc_bases) * inside / F.col(length)).alias("__g"))
    out = parts.groupBy(*by, "window").agg((F.sum("__n") / size).alias("depth"), (F.sum("__g") / F.sum("__n")).alias("gc"))
    if ends is not None:
        out = out.join(ends, by).filter((F.col("window") + 1) * size - 1 <= F.col("end")).drop("end")
    return out


def gc_medians(windows: DataFrame, gc: str = "gc", depth: str = "depth", mask: Column | None = None) -> DataFrame:
    """(bucket, median, n): by round(100 gc), the median of positive depths outside the mask; 0 where a bucket has none."""
    use = (F.col(depth) > 0) & (~mask if mask is not None else F.lit(True))
    kept = F.when(use, F.col(depth))
    return windows.groupBy(F.floor(F.col(gc) * 100 + 0.5).cast("long").alias("bucket")).agg(F.coalesce(F.percentile(kept, 0.5), F.lit(0.0)).alias("median"), F.count(kept).alias("n"))


def smoothed(medians: DataFrame, least: float = GC_LEAST, most: float = GC_MOST) -> DataFrame:
    """(bucket, smoothed) for buckets 0 to 100: the mean over a bucket and both neighbours, empty ones as 0.

    -1 unless the next bucket lies in (least, most]; buckets beyond the ends count as -1.
    """
    spine = medians.sparkSession.range(0, 101).select(F.col("id").alias("bucket"))
    full = spine.join(F.broadcast(medians.filter("bucket BETWEEN 0 AND 100")), "bucket", "left").select("bucket", F.coalesce("median", F.lit(0.0)).alias("m"))
    order = Window.orderBy("bucket")  # 101 rows
    mean = (F.coalesce(F.lag("m").over(order), F.lit(-1.0)) + F.col("m") + F.coalesce(F.lead("m").over(order), F.lit(-1.0))) / 3
    share = (F.col("bucket") + 1) / 100
    return full.select("bucket", F.when((share > least) & (share <= most), mean).otherwise(-1.0).alias("smoothed"))


def gc_normalised(windows: DataFrame, buckets: DataFrame, gc: str = "gc", depth: str = "depth") -> DataFrame:
    """The windows with ``ratio``: depth over its bucket's smoothed median; -1 where that is not positive. 101 buckets are broadcast."""
    keyed = windows.withColumn("bucket", F.floor(F.col(gc) * 100 + 0.5).cast("long"))
    return keyed.join(F.broadcast(buckets), "bucket", "left").withColumn("ratio", F.when(F.col("smoothed") > 0, F.col(depth) / F.col("smoothed")).otherwise(-1.0)).drop("smoothed", "bucket")


def mean_over_median(windows: DataFrame, ratio: str, depth: str, use: Column) -> DataFrame:
    """The windows with ratio times mean / median of the depths that ``use`` selects; one row of statistics is joined."""
    stats = windows.filter(use).agg((F.avg(depth) / F.percentile(depth, 0.5)).alias("__f"))
    return windows.crossJoin(F.broadcast(stats)).withColumn(ratio, F.when(F.col(ratio) > 0, F.col(ratio) * F.col("__f")).otherwise(F.col(ratio))).drop("__f")


def unity(windows: DataFrame, ratio: str, use: Column) -> DataFrame:
    """The windows with ratio divided by the mean of the positive ratios that ``use`` selects."""
    mean = windows.filter(use & (F.col(ratio) > 0)).agg(F.avg(ratio).alias("__m"))
    return windows.crossJoin(F.broadcast(mean)).withColumn(ratio, F.when(F.col(ratio) > 0, F.col(ratio) / F.col("__m")).otherwise(F.col(ratio))).drop("__m")


def rolling_median(windows: DataFrame, by: list[str], position: str, ratio: str, rows: int, least: int, expected: float = 1.0, bucket: int = 1 << 24) -> DataFrame:
    """The rows of positive ratio with ``rolled``: expected * ratio / the median over ``rows`` rows to both sides; unchanged under ``least`` rows in the frame.

    Rows are numbered over buckets of ``bucket`` positions, then dealt by number in blocks that carry ``rows`` rows of both neighbours along, so a key is many tasks. Of equal positions the lesser ratio comes first.
    """
    dealt = B.dealt(windows.filter(F.col(ratio) > 0), position, bucket)
    counted = B.carried(dealt, by, {"__rows": (F.count("*"), "sum")})
    nth = F.coalesce("__rows", F.lit(0)) + F.row_number().over(B.within(by).orderBy(position, ratio)) - 1
    size = max(1000, 8 * rows)
    numbered = counted.withColumn("__nth", nth).withColumn("__own", F.floor(F.col("__nth") / size).cast("long"))
    place = F.col("__nth") % size
    own = F.col("__own")
    blocks = F.array_compact(F.array(own, F.when(place < rows, own - 1), F.when(place >= size - rows, own + 1)))
    spread = numbered.withColumn(B.BUCKET, F.explode(blocks))
    frame = B.within(by).orderBy("__nth").rowsBetween(-rows, rows)
    median, n = F.percentile(ratio, 0.5).over(frame), F.count("*").over(frame)
    return spread.withColumns({"__median": median, "__count": n}).filter(own == F.col(B.BUCKET)).withColumn("rolled", F.when(F.col("__count") >= least, expected * F.col(ratio) / F.col("__median")).otherwise(F.col(ratio))).select(*windows.columns, "rolled")


def consolidated(windows: DataFrame, by: list[str], position: str, ratio: str, gc: str, count: int, most: int) -> DataFrame:
    """(by, position, ratio, gc, n): buckets of ``count`` rows of non-negative ratio, begun anew where a bucket would span ``most`` positions.

    Buckets are placed at their rounded centre. The restart depends on where each bucket began, so rows of one key are scanned in order, in blocks that gaps of
    ``most`` separate: across such a gap a bucket always begins anew.
    """
    import pandas as pd

    order = Window.partitionBy(*by).orderBy(position)
    used = windows.filter(F.col(ratio) >= 0)
    far = F.when(F.col(position) - F.lag(position).over(order) >= most, 1).otherwise(0)
    blocks = used.withColumn("__far", far).withColumn("__block", F.sum("__far").over(order))

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(position)
        bucket, first, held, ids = 0, None, 0, []
        for p in rows[position]:
            if held >= count or (held and p - first >= most):
                bucket, held = bucket + 1, 0
            first = p if not held else first
            held += 1
            ids.append(bucket)
        g = rows.assign(__b=ids).groupby("__b")
        out = pd.DataFrame({position: ((g[position].min() + g[position].max()) / 2 + 0.5).astype("int64"), ratio: g[ratio].mean(), gc: g[gc].mean(), "n": g.size()})
        for k in by:
            out[k] = rows[k].iloc[0]
        return out[[*by, position, ratio, gc, "n"]]

    kinds = ", ".join(f"{k} {windows.schema[k].dataType.simpleString()}" for k in by)
    return blocks.groupBy(*by, "__block").applyInPandas(scan, f"{kinds}, {position} long, {ratio} double, {gc} double, n long")


def medians(windows: DataFrame, by: list[str], ratio: str) -> DataFrame:
    """(by, median, n) of positive ratios; median 0 where a key has none."""
    positive = F.when(F.col(ratio) > 0, F.col(ratio))
    return windows.groupBy(*by).agg(F.coalesce(F.percentile(positive, 0.5), F.lit(0.0)).alias("median"), F.count(positive).alias("n"))


def consolidation_count(median_depth: Column) -> Column:
    """Windows to a bucket: 80 / depth to one significant digit, 1 under 10, 1000 at most."""
    raw = 80 / median_depth
    scale = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(raw < 10, 1).otherwise(F.least(F.lit(1000.0), F.round(raw / scale) * scale)).cast("int")

"""Depth windows over events: the event type stands for a chromosome, seconds for positions, the value for depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth as D
from ..storage import table
from .registry import query, seconds

HOUR = 3600
#: Events as reads: a start, a length, and GC bases.
READS = """WITH reads AS (SELECT event_type AS chromosome, CAST(floor(epoch(ts)) AS BIGINT) AS start, 600 + 300 * (event_id % 23) AS len, 6 * (40 + event_id % 25) AS gcb, value FROM events)"""
WINDOWS = READS + """, parts AS (
  SELECT chromosome, w AS win, least(start + len - 1, (w + 1) * 3600 - 1) - greatest(start, w * 3600) + 1 AS n, len, gcb
  FROM reads, unnest(generate_series(start // 3600, (start + len - 1) // 3600)) AS u(w)),
windows AS (SELECT chromosome, win, sum(n) / 3600.0 AS depth, sum(gcb * n / CAST(len AS DOUBLE)) / sum(n) AS gc FROM parts GROUP BY ALL)"""
BUCKETS = WINDOWS + """, med AS (SELECT CAST(floor(gc * 100 + 0.5) AS BIGINT) AS bucket, coalesce(quantile_cont(depth, 0.5) FILTER (depth > 0), 0) AS median, count(*) FILTER (depth > 0) AS n FROM windows GROUP BY 1),
spine AS (SELECT s AS bucket, coalesce(median, 0) AS m FROM unnest(generate_series(0, 100)) AS u(s) LEFT JOIN med ON med.bucket = s),
smooth AS (SELECT bucket, CASE WHEN (bucket + 1) / 100.0::DOUBLE > 0.05 AND (bucket + 1) / 100.0::DOUBLE <= 0.68 THEN (coalesce(lag(m) OVER (ORDER BY bucket), -1) + m + coalesce(lead(m) OVER (ORDER BY bucket), -1)) / 3 ELSE -1 END AS smoothed FROM spine)"""
RATIOS = BUCKETS + """, ratios AS (SELECT chromosome, win, depth, gc, CASE WHEN smoothed > 0 THEN depth / smoothed ELSE -1 END AS ratio FROM windows LEFT JOIN smooth ON smooth.bucket = CAST(floor(gc * 100 + 0.5) AS BIGINT))"""
LEAST = 0.05


def reads(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("chromosome"), seconds().alias("start"), (600 + 300 * (F.col("event_id") % 23)).alias("len"), (6 * (40 + F.col("event_id") % 25)).alias("gcb"), "value")


def windows(spark, sf_dir):
    return D.window_depth(reads(spark, sf_dir), ["chromosome"], "start", "len", "gcb", HOUR)


def ratios(spark, sf_dir):
    w = windows(spark, sf_dir)
    return D.gc_normalised(w, D.smoothed(D.gc_medians(w), LEAST))


@query(WINDOWS + " SELECT chromosome, win::BIGINT AS win, round(depth, 6) AS depth, round(gc, 6) AS gc FROM windows")
def window_depth(spark, sf_dir):
    return windows(spark, sf_dir).select("chromosome", F.col("window").alias("win"), F.round("depth", 6).alias("depth"), F.round("gc", 6).alias("gc"))


@query(BUCKETS + " SELECT bucket, round(median, 6) AS median, n FROM med")
def gc_bucket_median(spark, sf_dir):
    return D.gc_medians(windows(spark, sf_dir)).select("bucket", F.round("median", 6).alias("median"), "n")


@query(BUCKETS + " SELECT bucket, round(smoothed, 6) AS smoothed FROM smooth")
def bucket_smooth3(spark, sf_dir):
    return D.smoothed(D.gc_medians(windows(spark, sf_dir)), LEAST).select("bucket", F.round("smoothed", 6).alias("smoothed"))


@query(RATIOS + " SELECT chromosome, win::BIGINT AS win, round(ratio, 6) AS ratio FROM ratios")
def gc_ratio(spark, sf_dir):
    return ratios(spark, sf_dir).select("chromosome", F.col("window").alias("win"), F.round("ratio", 6).alias("ratio"))


@query(RATIOS + """, f AS (SELECT avg(depth) / quantile_cont(depth, 0.5) AS f FROM ratios WHERE chromosome <> 'error' AND ratio > 0)
SELECT chromosome, win::BIGINT AS win, round(CASE WHEN ratio > 0 THEN ratio * f ELSE ratio END, 6) AS ratio FROM ratios, f""")
def median_mean_norm(spark, sf_dir):
    out = D.mean_over_median(ratios(spark, sf_dir), "ratio", "depth", (F.col("chromosome") != "error") & (F.col("ratio") > 0))
    return out.select("chromosome", F.col("window").alias("win"), F.round("ratio", 6).alias("ratio"))


@query(RATIOS + """, f AS (SELECT avg(ratio) AS f FROM ratios WHERE chromosome <> 'error' AND ratio > 0)
SELECT chromosome, win::BIGINT AS win, round(CASE WHEN ratio > 0 THEN ratio / f ELSE ratio END, 6) AS ratio FROM ratios, f""")
def unity_norm(spark, sf_dir):
    out = D.unity(ratios(spark, sf_dir), "ratio", F.col("chromosome") != "error")
    return out.select("chromosome", F.col("window").alias("win"), F.round("ratio", 6).alias("ratio"))


@query("""WITH r AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_id, value FROM events WHERE value > 0)
SELECT event_id, round(CASE WHEN count(*) OVER w >= 5 THEN value / quantile_cont(value, 0.5) OVER w ELSE value END, 6) AS rolled FROM r
WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)""")
def rolling_median_norm(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return D.rolling_median(e, ["user_id"], "event_id", "value", 7, 5, bucket=1 << 16).select("event_id", F.round("rolled", 6).alias("rolled"))


@query(RATIOS + " SELECT chromosome, round(coalesce(quantile_cont(ratio, 0.5) FILTER (ratio > 0), 0), 6) AS median, count(*) FILTER (ratio > 0) AS n FROM ratios GROUP BY 1")
def chromosome_medians(spark, sf_dir):
    return D.medians(ratios(spark, sf_dir), ["chromosome"], "ratio").select("chromosome", F.round("median", 6).alias("median"), "n")


@query(WINDOWS + """, o AS (SELECT *, (row_number() OVER (PARTITION BY chromosome ORDER BY win) - 1) // 4 AS b FROM windows)
SELECT chromosome, CAST(floor((min(win) + max(win)) / 2.0 + 0.5) AS BIGINT) AS win, round(avg(depth), 6) AS ratio, round(avg(gc), 6) AS gc, count(*) AS n FROM o GROUP BY chromosome, b""")
def low_cov_consolidate(spark, sf_dir):
    w = windows(spark, sf_dir).withColumnsRenamed({"window": "win", "depth": "ratio"})
    return D.consolidated(w, ["chromosome"], "win", "ratio", "gc", 4, 10**9).select("chromosome", "win", F.round("ratio", 6).alias("ratio"), F.round("gc", 6).alias("gc"), "n")

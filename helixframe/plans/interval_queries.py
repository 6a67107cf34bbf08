"""Interval queries: a customer's or user's rows stand for a chromosome, days or seconds for positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..storage import table
from .registry import days, query, seconds

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"
ORDERS = f"o AS (SELECT o_orderkey, o_custkey AS k, {DAY.format('o_orderdate')} AS a, {DAY.format('o_orderdate')} + o_orderkey % 60 AS b FROM orders)"
ITEMS = f"i AS (SELECT l_orderkey, l_linenumber, o_custkey AS k, {DAY.format('l_shipdate')} AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def spans(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_custkey").alias("k"), days("o_orderdate").alias("a"), (days("o_orderdate") + F.col("o_orderkey") % 60).alias("b"))


def points(spark, sf_dir, tasks=None):
    """tasks: how many join items and orders; else as many as the session has."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k"))
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", days("l_shipdate").alias("p"))
    return (i.repartition(tasks, "l_orderkey") if tasks else i).join(o.repartition(tasks, "l_orderkey") if tasks else o, "l_orderkey")


@query(f"WITH {ORDERS}, {ITEMS} SELECT o_orderkey, count(*) AS n, min(l_orderkey) AS least, sum(p)::BIGINT AS total FROM i JOIN o ON i.k = o.k AND p BETWEEN a AND b GROUP BY 1")
def range_join_sites(spark, sf_dir):
    found = I.range_join(points(spark, sf_dir).withColumn("q", F.col("p")), spans(spark, sf_dir), ["k"], ("p", "q"), ("a", "b"), 64)
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("least"), F.sum("p").alias("total"))


@query(f"WITH {ORDERS} SELECT x.o_orderkey, count(y.o_orderkey) AS n, coalesce(sum(y.o_orderkey), 0)::BIGINT AS total FROM o x LEFT JOIN o y ON x.k = y.k AND x.a <= y.b + 3 AND y.a - 3 <= x.b AND x.o_orderkey < y.o_orderkey GROUP BY 1")
def band_join_slack(spark, sf_dir):
    o = spans(spark, sf_dir)
    other = o.withColumnsRenamed({"o_orderkey": "other", "a": "c", "b": "d"})
    found = I.range_join(o, other, ["k"], ("a", "b"), ("c", "d"), 64, "inner", 3).filter("o_orderkey < other").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("other").alias("total"))
    return o.select("o_orderkey").join(found, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


@query(f"WITH {ORDERS} SELECT x.o_orderkey, y.o_orderkey AS site FROM o x LEFT JOIN o y ON x.k = y.k AND y.a BETWEEN x.a AND x.b AND x.o_orderkey <> y.o_orderkey")
def range_join_left(spark, sf_dir):
    o = spans(spark, sf_dir)
    sites = o.select(F.col("o_orderkey").alias("site"), "k", F.col("a").alias("c"), F.col("a").alias("d"))
    left = o
    pairs = I.range_join(left, sites, ["k"], ("a", "b"), ("c", "d"), 64).filter("o_orderkey != site").select("o_orderkey", "site")
    return left.select("o_orderkey").join(pairs, "o_orderkey", "left")


ASOF = f"""WITH s AS (SELECT o_custkey AS k, {DAY.format('o_orderdate')} AS t, max(o_totalprice) AS price FROM orders GROUP BY ALL), {ITEMS}
SELECT l_orderkey, l_linenumber, round(s.price, 2) AS price FROM (SELECT *, p - 40 AS q FROM i) i ASOF LEFT JOIN s ON i.k = s.k AND i.q >= s.t"""


@query(ASOF)
def asof_copy_number(spark, sf_dir):
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // 250_000))  # counted in the files' footers
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), days("o_orderdate").alias("t"), "o_totalprice")
    price = o.repartition(tasks, "k").groupBy("k", "t").agg(F.max("o_totalprice").alias("price"))
    found = I.asof_join(points(spark, sf_dir, tasks).withColumn("q", F.col("p") - 40), price, ["k"], "q", "t", ["price"], bucket=512, tasks=tasks)
    return found.select("l_orderkey", "l_linenumber", F.round("price", 2).alias("price"))


@query(f"""WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type FROM events)
SELECT event_id, least(t - (SELECT max(b.t) FROM e b WHERE b.user_id = a.user_id AND b.event_type <> a.event_type AND (b.t, b.event_type) < (a.t, a.event_type)),
  (SELECT min(b.t) FROM e b WHERE b.user_id = a.user_id AND b.event_type <> a.event_type AND (b.t, b.event_type) > (a.t, a.event_type)) - t) AS nearest FROM e a""")
def nearest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", seconds().alias("t"), "event_type")
    return I.nearest(e, ["user_id"], "t", "event_type").select("event_id", "nearest")


@query("""WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, value FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 7200 THEN 1 ELSE 0 END AS f FROM e),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t) + 1 AS island FROM g)
SELECT user_id, island::BIGINT AS island, min(t) AS first, max(t) AS last, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY ALL""")
def gap_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", seconds().alias("t"), "value")
    return I.islands(e, ["user_id"], "t", 7200).groupBy("user_id", "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events WHERE event_type IN ('click', 'error')),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 20000 THEN 1 ELSE 0 END AS f FROM e),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t) AS island FROM g)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n, CAST(floor((max(t) - min(t)) / (count(*) - 1.0) + 0.5) AS BIGINT) AS mean_gap FROM i GROUP BY user_id, island
HAVING count(*) >= 3 AND floor((max(t) - min(t)) / (count(*) - 1.0) + 0.5) <= 10000""")
def kataegis(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error")).select("user_id", seconds().alias("t"))
    runs = I.islands(e, ["user_id"], "t", 20000).groupBy("user_id", "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).filter("n >= 3")
    return runs.withColumn("mean_gap", F.floor((F.col("last") - F.col("first")) / (F.col("n") - 1) + 0.5)).filter("mean_gap <= 10000").drop("island")


MERGE = f"""{ORDERS}, r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM r),
m AS (SELECT k, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY k, g)"""


@query(f"WITH {MERGE} SELECT k, a::BIGINT AS a, b::BIGINT AS b, n FROM m")
def interval_merge(spark, sf_dir):
    return I.merged(spans(spark, sf_dir), ["k"], "a", "b", bucket=512)


@query(f"WITH {MERGE}, g2 AS (SELECT k, b + 1 AS a, lead(a) OVER (PARTITION BY k ORDER BY a) - 1 AS b FROM m) SELECT k, a::BIGINT AS a, b::BIGINT AS b FROM g2 WHERE b IS NOT NULL")
def interval_subtract(spark, sf_dir):
    o = spans(spark, sf_dir)
    whole = o.groupBy("k").agg(F.min("a").alias("a"), F.max("b").alias("b")).withColumn("target", F.col("k"))
    return I.subtracted(whole, o, ["k"], "a", "b", 128, "target", bucket=512).select("k", "a", "b")


COVER = f"""{ORDERS}, s AS (SELECT k, p, sum(d) AS d FROM (SELECT k, a AS p, 1 AS d FROM o UNION ALL SELECT k, b + 1, -1 FROM o) GROUP BY ALL HAVING sum(d) <> 0),
c AS (SELECT k, p AS a, lead(p) OVER (PARTITION BY k ORDER BY p) - 1 AS b, sum(d) OVER (PARTITION BY k ORDER BY p) AS depth FROM s)"""


@query(f"WITH {COVER} SELECT k, a::BIGINT AS a, b::BIGINT AS b, depth::BIGINT AS depth FROM c WHERE depth > 0")
def coverage_depth(spark, sf_dir):
    return I.coverage(spans(spark, sf_dir), ["k"], "a", "b", bucket=512)


@query(f"""WITH {COVER}, h AS (SELECT * FROM c WHERE depth >= 2), f AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY k ORDER BY a) - 1 > 30 THEN 1 ELSE 0 END AS f FROM h),
g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY a) AS g FROM f)
SELECT k, min(a)::BIGINT AS a, max(b)::BIGINT AS b, arg_min(depth, a)::BIGINT AS first_depth, max(depth)::BIGINT AS max_depth FROM g GROUP BY k, g""")
def high_depth_regions(spark, sf_dir):
    return I.high_depth(spans(spark, sf_dir), ["k"], "a", "b", 2, 30, bucket=512)


@query(f"WITH {ORDERS} SELECT o_orderkey, a::BIGINT AS start, coalesce(lead(a) OVER (PARTITION BY k ORDER BY a, o_orderkey) - 1, b)::BIGINT AS end_, lag(b) OVER (PARTITION BY k ORDER BY a, o_orderkey)::BIGINT AS support FROM o")
def segment_support(spark, sf_dir):
    order = Window.partitionBy("k").orderBy("a", "o_orderkey")
    return spans(spark, sf_dir).select("o_orderkey", F.col("a").alias("start"), F.coalesce(F.lead("a").over(order) - 1, F.col("b")).alias("end_"), F.lag("b").over(order).alias("support"))

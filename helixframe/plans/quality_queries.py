"""Quality control and cohort summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quality as K
from ..operators.ordered import aggregated
from ..storage import placed, table
from .interval_queries import spans
from .registry import query
from .tumor_queries import SEGMENTS, segments


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


STATUS = """v AS (SELECT l_suppkey AS s, avg(l_quantity) AS q, avg(l_discount) AS d, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
t AS (SELECT s, 'q' AS feature, q AS value, CASE WHEN q > 26 THEN 'FAIL' WHEN q > 25.5 THEN 'WARN' ELSE 'PASS' END AS status FROM v UNION ALL SELECT s, 'd', d, CASE WHEN d > 0.051 THEN 'WARN' ELSE 'PASS' END FROM v UNION ALL SELECT s, 'n', n, CASE WHEN n < 550 THEN 'FAIL' WHEN n < 590 THEN 'WARN' ELSE 'PASS' END FROM v)"""


def _statuses(spark, sf_dir):
    rows = placed(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), "l_quantity", "l_discount", "__file", "__row")
    v = aggregated(rows, ["s"], ["__file", "__row"], q=F.avg("l_quantity"), d=F.avg("l_discount"), n=F.count("*"))
    return K.statuses(v, [("q", 25.5, 26.0, True), ("d", 0.051, None, True), ("n", 590.0, 550.0, False)], "s")


@query(f"WITH {STATUS} SELECT s, feature, round(value, 8) AS value, status FROM t")
def qc_status(spark, sf_dir):
    return _statuses(spark, sf_dir).withColumn("value", F.round("value", 8))


@query(f"WITH {STATUS} SELECT s, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM t GROUP BY 1")
def qc_worst(spark, sf_dir):
    return K.worst(_statuses(spark, sf_dir), "s")


@query("""WITH m AS (SELECT l_suppkey AS s, l_partkey % 22 AS c, sum(l_quantity / 17 * l_tax) / sum(l_tax) AS m FROM lineitem GROUP BY ALL) SELECT s, count(*) FILTER (m >= 1.5) >= 11 AS duplicated FROM m GROUP BY 1""")
def genome_duplication(spark, sf_dir):
    i = placed(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 22).alias("c"), (F.col("l_quantity") / 17).alias("m"), F.col("l_tax").alias("w"), "__file", "__row")
    return K.whole_genome_duplication(i, "s", "c", "m", "w", order=["__file", "__row"])


@query(f"""WITH {SEGMENTS} SELECT chromosome % 100 AS sample, round(sum(CASE WHEN abs(cn - floor(cn + 0.5)) > 0.25 THEN "end" - start + 1 ELSE 0 END) / sum("end" - start + 1)::DOUBLE, 8) AS share FROM s GROUP BY 1""")
def polyclonal_share(spark, sf_dir):
    s = segments(spark, sf_dir).select((F.col("chromosome") % 100).alias("sample"), "cn", (F.col("end") - F.col("start") + 1).alias("w"))
    return K.polyclonal_share(s, "sample", "cn", "w").withColumn("share", F.round("share", 8))


@query(f"""WITH {SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY chromosome ORDER BY start) AS n FROM s) SELECT chromosome, start::BIGINT AS start FROM n WHERE n > 1 AND start % 3 <> 0""")
def inferred_breakends(spark, sf_dir):
    s = segments(spark, sf_dir)
    return K.without_support(s, s.filter("start % 3 = 0"), ["chromosome"], "start").select("chromosome", "start")


@query(f"""WITH o AS (SELECT o_orderkey, o_custkey AS k, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS a, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 60 AS b FROM orders),
d AS (SELECT o_orderkey, k, unnest(generate_series(a, b)) AS p FROM o), x AS (SELECT DISTINCT k, unnest(generate_series(a, b)) AS p FROM o WHERE o_orderkey % 7 = 0)
SELECT o_orderkey, count(*) AS n, count(x.p) AS inside FROM d LEFT JOIN x ON d.k = x.k AND d.p = x.p GROUP BY 1""")
def excluded_split(spark, sf_dir):
    o = spans(spark, sf_dir)
    parts = K.split_at(o, o.filter("o_orderkey % 7 = 0"), ["k"], "a", "b", "o_orderkey", 64)
    size = F.col("b") - F.col("a") + 1
    return parts.groupBy("o_orderkey").agg(F.sum(size).alias("n"), F.sum(F.when(F.col("excluded"), size).otherwise(0)).alias("inside"))


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS samples, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_suppkey END) AS suspicious FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 20 AND count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_suppkey END) >= 0.6 * count(DISTINCT l_suppkey)")
def site_blacklist(spark, sf_dir):
    return K.recurrent_sites(items(spark, sf_dir), ["l_partkey"], "l_suppkey", F.col("l_discount") > 0.05, 0.6, 20)


@query("""WITH r AS (SELECT l_orderkey AS name, (CASE WHEN l_linenumber % 2 = 1 THEN 65 ELSE 129 END) + CASE WHEN l_linenumber > 2 THEN 2048 ELSE 0 END AS f FROM lineitem),
n AS (SELECT name, count(*) AS n, count(*) FILTER (f & 2304 = 0 AND f & 64 <> 0) AS a, count(*) FILTER (f & 2304 = 0 AND f & 128 <> 0) AS b FROM r GROUP BY 1)
SELECT name, n, CASE WHEN a <> 1 THEN 'FIRST' ELSE 'SECOND' END AS problem FROM n WHERE a <> 1 OR b <> 1""")
def fragment_check(spark, sf_dir):
    n = F.col("l_linenumber")
    flags = F.when(n % 2 == 1, 65).otherwise(129) + F.when(n > 2, 2048).otherwise(0)
    return K.incomplete_fragments(items(spark, sf_dir).select(F.col("l_orderkey").alias("name"), flags.alias("f")), "name", "f")


@query("SELECT CASE WHEN l_quantity = 50 THEN 'HOTSPOT' WHEN l_partkey % 10 = 0 THEN 'PANEL' WHEN l_returnflag = 'R' THEN 'HIGH_CONFIDENCE' ELSE 'LOW_CONFIDENCE' END AS tier, count(*) AS n FROM lineitem GROUP BY 1")
def tier_select(spark, sf_dir):
    t = K.tier(F.col("l_quantity") == 50, F.col("l_partkey") % 10 == 0, F.col("l_returnflag") == "R")
    return items(spark, sf_dir).groupBy(t.alias("tier")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_partkey, count(*) AS depth, count(*) FILTER (l_returnflag = 'A') AS support FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT p_partkey AS l_partkey, coalesce(depth, 0) AS rna_depth, coalesce(support, 0) AS rna_support FROM part LEFT JOIN e ON p_partkey = l_partkey""")
def append_sample(spark, sf_dir):
    e = items(spark, sf_dir).filter("l_quantity > 45").groupBy("l_partkey").agg(F.count("*").alias("depth"), F.count_if(F.col("l_returnflag") == "A").alias("support"))
    return K.appended(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey")), e, ["l_partkey"], "rna")


@query("""WITH r AS (SELECT l_suppkey % 7 AS a, l_partkey % 6 AS p FROM lineitem), c AS (SELECT a AS class, 1 AS na, 0 AS np, (a = p)::INT AS ok FROM r UNION ALL SELECT p, 0, 1, 0 FROM r)
SELECT class, sum(na)::BIGINT AS n, sum(np)::BIGINT AS predicted, sum(ok)::BIGINT AS correct, round(sum(ok) / nullif(sum(na), 0)::DOUBLE, 8) AS recall, round(sum(ok) / nullif(sum(np), 0)::DOUBLE, 8) AS precision FROM c GROUP BY 1""")
def confusion_matrix(spark, sf_dir):
    r = items(spark, sf_dir).select((F.col("l_suppkey") % 7).alias("a"), (F.col("l_partkey") % 6).alias("p"))
    return K.confusion(r, "a", "p").withColumns({"recall": F.round("recall", 8), "precision": F.round("precision", 8)})


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS term, c_custkey // 3 AS ancestor FROM customer WHERE c_custkey > 0 UNION SELECT c_custkey, c_custkey // 5 FROM customer WHERE c_custkey % 4 = 3), a(term, ancestor) AS (SELECT * FROM e UNION SELECT a.term, e.ancestor FROM a JOIN e ON a.ancestor = e.term) SELECT term, ancestor FROM a""")
def ontology_parents(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    e = c.filter(k > 0).select(k.alias("term"), F.floor(k / 3).alias("ancestor")).union(c.filter(k % 4 == 3).select(k, F.floor(k / 5)))
    return K.ancestors(e, "term", "ancestor")


@query("""WITH h AS (SELECT DISTINCT sha256(c_custkey::VARCHAR || 's') AS hash FROM customer), k AS (SELECT hash, row_number() OVER (ORDER BY hash) AS id FROM (SELECT DISTINCT sha256(c_custkey::VARCHAR || 's') AS hash FROM customer WHERE c_custkey % 5 = 0))
SELECT hash, id FROM k UNION ALL SELECT hash, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY hash) FROM h WHERE hash NOT IN (SELECT hash FROM k)""")
def sample_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    known = K.new_ids(c.filter("c_custkey % 5 = 0"), spark.createDataFrame([], "hash string, id long"), "c_custkey", "s")
    return K.new_ids(c, known, "c_custkey", "s")


@query("""SELECT l_suppkey, CAST(floor(l_partkey / 100) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def position_frequencies(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_suppkey", F.floor(F.col("l_partkey") / 100).alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(l_quantity AS BIGINT) AS length, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 8) AS share, round(sum(count(*)) OVER (ORDER BY CAST(l_quantity AS BIGINT)) / sum(count(*)) OVER ()::DOUBLE, 8) AS upto FROM lineitem GROUP BY 1""")
def fragment_lengths(spark, sf_dir):
    n = items(spark, sf_dir).groupBy(F.col("l_quantity").cast("long").alias("length")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each length
    return n.select("length", "n", F.round(F.col("n") / total, 8).alias("share"), F.round(F.sum("n").over(Window.orderBy("length")) / total, 8).alias("upto"))


@query("""WITH s AS (SELECT l_suppkey, l_partkey % 30 AS gene, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY ALL) SELECT gene, count(*) AS samples, count(*) FILTER (k = 3) AS biallelic, round(avg(k), 8) AS load FROM s GROUP BY 1""")
def mutational_load(spark, sf_dir):
    s = items(spark, sf_dir).groupBy("l_suppkey", (F.col("l_partkey") % 30).alias("gene")).agg(F.count_distinct("l_returnflag").alias("k"))
    return s.groupBy("gene").agg(F.count("*").alias("samples"), F.count_if(F.col("k") == 3).alias("biallelic"), F.round(F.avg("k"), 8).alias("load"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY o_totalprice >= max(o_totalprice) OVER (PARTITION BY o_custkey) * 0.9 ")
def near_top(spark, sf_dir):
    top = F.max("o_totalprice").over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").withColumn("t", top).filter(F.col("o_totalprice") >= F.col("t") * 0.9).select("o_custkey", "o_orderkey", "o_totalprice")

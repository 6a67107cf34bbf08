"""Impacts, targets and detection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import purity as P
from ..operators import cohort as C
from ..operators import effects as E
from ..storage import table
from .registry import days, query
from .tumor_queries import SEGMENTS, segments

LIST = "[" + ", ".join(f"'{e}'" for e in E.EFFECTS) + ", 'other']"
DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


@query(f"""WITH i AS (SELECT DISTINCT l_orderkey AS v, l_suppkey % 20 AS gene, l_partkey AS transcript, l_returnflag = 'A' AS canonical, ({LIST})[1 + (l_partkey + l_linenumber) % 17] AS effect, (l_partkey + l_linenumber) % 17 AS s FROM lineitem),
w AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY s, gene, transcript, canonical) AS n, row_number() OVER (PARTITION BY v, canonical ORDER BY s, gene, transcript) AS k FROM i)
SELECT v, max(effect) FILTER (n = 1) AS worst_effect, max(gene) FILTER (n = 1) AS worst_gene, max(effect) FILTER (canonical AND k = 1) AS canonical_effect, count(DISTINCT gene) AS genes FROM w GROUP BY 1""")
def impact_summary(spark, sf_dir):
    effect = F.get(F.array(*[F.lit(e) for e in [*E.EFFECTS, "other"]]), ((F.col("l_partkey") + F.col("l_linenumber")) % 17).cast("int"))
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("v"), (F.col("l_suppkey") % 20).alias("gene"), F.col("l_partkey").alias("transcript"), (F.col("l_returnflag") == "A").alias("canonical"), effect.alias("effect"))
    return E.impact_summary(i, ["v"])


@query(f"""WITH {SEGMENTS}, t AS (SELECT c_custkey AS target, c_custkey AS chromosome, 9000 + c_custkey % 500 AS a, 9600 + c_custkey % 700 AS b FROM customer),
w AS (SELECT o_custkey AS chromosome, {DAY.format('l_shipdate')} AS position, l_quantity AS depth FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT target, count(*) AS windows, avg(depth) AS d FROM t JOIN w ON t.chromosome = w.chromosome AND position BETWEEN a AND b GROUP BY 1),
c AS (SELECT target, sum(cn * (least(b, "end") - greatest(a, start) + 1)) / sum(least(b, "end") - greatest(a, start) + 1) AS cn FROM t JOIN s ON t.chromosome = s.chromosome AND a <= "end" AND start <= b GROUP BY 1)
SELECT target, coalesce(windows, 0) AS windows, round(d, 6) AS mean_depth, round(cn, 6) AS mean_cn FROM t LEFT JOIN p USING (target) LEFT JOIN c USING (target)""")
def target_regions(spark, sf_dir):
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(k.alias("target"), k.alias("chromosome"), (9000 + k % 500).alias("a"), (9600 + k % 700).alias("b"))
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("chromosome"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", days("l_shipdate").alias("position"), F.col("l_quantity").alias("depth")).join(w, "l_orderkey")
    return E.target_copy_number(t, rows, segments(spark, sf_dir), 128).withColumns({"mean_depth": F.round("mean_depth", 6), "mean_cn": F.round("mean_cn", 6)})


@query(f"""WITH {SEGMENTS}, r AS (SELECT chromosome, start, "end", CASE WHEN minor < 0.3 THEN 'HOM_DELETION' ELSE 'AMPLIFICATION' END AS status FROM s WHERE minor < 0.3 OR cn > 4.5), g AS (SELECT c_custkey * 10 + k AS gene, c_custkey AS chromosome, 8800 + 500 * k AS a, 9000 + 500 * k AS b FROM customer, unnest([0, 1, 2, 3]) AS u(k))
SELECT DISTINCT gene, status, s.cn FROM r JOIN s ON r.chromosome = s.chromosome AND r.start BETWEEN s.start AND s."end" JOIN g ON g.chromosome = r.chromosome AND r.start <= b AND a <= r."end\"""")
def germline_amp_del(spark, sf_dir):
    s = segments(spark, sf_dir)
    r = s.filter("minor < 0.3 OR cn > 4.5").select("chromosome", "start", "end", F.when(F.col("minor") < 0.3, "HOM_DELETION").otherwise("AMPLIFICATION").alias("status"))
    g = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"))
    genes = g.select((F.col("c_custkey") * 10 + F.col("k")).alias("gene"), F.col("c_custkey").alias("chromosome"), (8800 + 500 * F.col("k")).cast("long").alias("a"), (9000 + 500 * F.col("k")).cast("long").alias("b"))
    return E.germline_events(r, s, genes, 128)


@query("""WITH s AS (SELECT l_suppkey AS s, count(*) FILTER (l_linenumber = 7 AND l_quantity > 45) AS n, count(*) / 140.0::DOUBLE AS m FROM lineitem GROUP BY 1), p AS (SELECT *, 1 - CASE WHEN n = 0 THEN 0 ELSE list_sum(list_transform(generate_series(0, n - 1), lambda i: exp(i * ln(m) - m - lgamma(i + 1)))) END AS p FROM s)
SELECT s, n, round(p, 6) AS p, p < 0.2 AS detected FROM p""")
def tumor_detection(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.count_if((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45)).alias("n"), (F.count("*") / 140).alias("m"))
    return E.detection(s, F.col("n"), F.col("m"), 0.2).select("s", "n", F.round("p", 6).alias("p"), "detected")


@query("""WITH f AS (SELECT s, (xy - x * y / w) / (xx - x * x / w) AS slope FROM (SELECT l_suppkey AS s, sum(l_tax + 1) AS w, sum((l_tax + 1) * l_quantity / 25) AS x, sum((l_tax + 1) * (0.4 * l_quantity / 25 + l_discount)) AS y, sum((l_tax + 1) * (l_quantity / 25) * (l_quantity / 25)) AS xx, sum((l_tax + 1) * (l_quantity / 25) * (0.4 * l_quantity / 25 + l_discount)) AS xy FROM lineitem GROUP BY 1))
SELECT s, round(greatest(0, least(1, 2 * slope / (1 + (2 - 3.1) * slope))), 6) AS purity FROM f""")
def copy_number_purity(spark, sf_dir):
    x = F.col("l_quantity") / 25
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), x.alias("x"), (0.4 * F.col("l_quantity") / 25 + F.col("l_discount")).alias("y"), (F.col("l_tax") + 1).alias("w"))
    fit = C.linear_fit(rows, ["s"], "x", "y", "w")
    return fit.select("s", F.round(P.cn_purity(F.col("slope"), F.lit(3.1)), 6).alias("purity"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, round((l_quantity / (l_tax + 0.01) / (l_tax + 0.01) + l_linenumber / 0.04) / (1 / (l_tax + 0.01) / (l_tax + 0.01) + 1 / 0.04), 6) AS jcn, round(sqrt(1 / (1 / (l_tax + 0.01) / (l_tax + 0.01) + 1 / 0.04)), 8) AS uncertainty FROM lineitem""")
def junction_copy_number(spark, sf_dir):
    value, spread = P.combined_estimate(F.col("l_quantity"), F.col("l_tax") + 0.01, F.col("l_linenumber"), F.lit(0.2))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.round(value, 6).alias("jcn"), F.round(spread, 8).alias("uncertainty"))

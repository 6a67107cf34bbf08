"""Summaries, features and classifiers: suppliers stand for samples, parts for genes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators.ordered import aggregated
from ..storage import placed, table
from .registry import days, query
from .sv_queries import pick

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


def items(spark, sf_dir, *columns):
    return table(spark, sf_dir, "lineitem").select(*columns)


@query("""WITH a AS (SELECT l_suppkey AS s, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber <> 7) AS v FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1), b AS (SELECT l_suppkey AS s, count(*) FILTER (l_discount < 0.03) AS g FROM lineitem GROUP BY 1), c AS (SELECT l_suppkey AS s, count(*) AS n, count(*) FILTER (l_linenumber % 2 = 0 AND l_partkey % 3 = 0) AS u FROM lineitem WHERE l_quantity > 10 GROUP BY 1)
SELECT coalesce(a.s, b.s, c.s) AS sample, coalesce(v, 0) AS sv_burden, coalesce(g, 0) AS deleted_genes, coalesce(n, 0) AS segments, coalesce(u, 0) AS unsupported FROM a FULL JOIN b ON a.s = b.s FULL JOIN c ON coalesce(a.s, b.s) = c.s""")
def structural_burden(spark, sf_dir):
    c = F.col
    i = table(spark, sf_dir, "lineitem")
    s = c("l_suppkey").alias("sample")
    v = i.filter("l_partkey % 2 = 0").select(s, F.when(c("l_returnflag") != "R", "PASS").otherwise("LOW").alias("filters"), F.when(c("l_linenumber") == 7, "INF").otherwise("DEL").alias("type"))
    g = i.select(s, (c("l_discount") * 0.5 / 0.03).alias("min_cn"))
    w = i.filter("l_quantity > 10").select(s, F.when(c("l_linenumber") % 2 == 0, "NONE").otherwise("SV").alias("start_support"), F.when(c("l_partkey") % 3 == 0, "NONE").otherwise("SV").alias("end_support"))
    return X.structural_burden(v, g, w, 0.5)


IMPACTS = ["MISSENSE", "NONSENSE", "SPLICE", "INFRAME", "FRAMESHIFT"]


@query("SELECT l_suppkey AS sample, l_partkey % 50 AS gene, " + ", ".join(f"count(*) FILTER (l_linenumber % 5 = {i}) AS {x.lower()}" for i, x in enumerate(IMPACTS)) + ", bool_or(l_quantity > 45) AS biallelic, bool_or(l_orderkey % 19 = 0) AS hotspot, max(l_discount * 10) AS likelihood FROM lineitem GROUP BY ALL")
def driver_catalog(spark, sf_dir):
    c = F.col
    v = items(spark, sf_dir, c("l_suppkey").alias("sample"), (c("l_partkey") % 50).alias("gene"), pick(IMPACTS, c("l_linenumber") % 5).alias("impact"), (c("l_quantity") > 45).alias("biallelic"), (c("l_orderkey") % 19 == 0).alias("hotspot"), (c("l_discount") * 10).alias("likelihood"))
    return X.driver_catalog(v, IMPACTS)


@query("SELECT l_suppkey AS sample, l_orderkey AS o, l_linenumber AS n, l_partkey AS gene FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25 AND l_quantity >= (2 + l_tax * 10) * 5 * CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 24 = 23 THEN 0.5 ELSE 1 END")
def driver_genes(spark, sf_dir):
    c = F.col
    g = items(spark, sf_dir, c("l_suppkey").alias("sample"), c("l_orderkey").alias("o"), c("l_linenumber").alias("n"), c("l_partkey").alias("gene"), F.when(c("l_partkey") % 24 == 23, "X").otherwise("1").alias("chromosome"), (c("l_suppkey") % 2 == 0).alias("male"), c("l_quantity").alias("min_cn"), (2 + c("l_tax") * 10).alias("ploidy"))
    panel = table(spark, sf_dir, "part").filter("p_size > 25").select(c("p_partkey").alias("gene"))
    return X.panel_genes(g, panel, "ploidy", 5.0).select("sample", "o", "n", "gene")


@query("""WITH v AS (SELECT l_suppkey AS s, CASE WHEN l_linenumber % 2 = 0 THEN 'ins' ELSE 'del' END AS k, l_partkey % 8 + 1 AS z, l_orderkey % 3 AS r, l_suppkey % 4 AS h FROM lineitem)
SELECT s AS sample, CASE WHEN r > 1 THEN k || '.rep.len.' || least(z, 5) WHEN k = 'del' AND h > 0 THEN 'del.mh.bimh.' || least(h, 5) ELSE k || '.none.len.' || least(z, 5) END AS context, count(*) AS n FROM v GROUP BY ALL""")
def indel_contexts(spark, sf_dir):
    c = F.col
    long_ = F.repeat(F.lit("A"), (c("l_partkey") % 8 + 2).cast("int"))
    inserted = c("l_linenumber") % 2 == 0
    context = X.indel_context(F.when(inserted, "A").otherwise(long_), F.when(inserted, long_).otherwise("A"), c("l_orderkey") % 3, c("l_suppkey") % 4)
    return items(spark, sf_dir, c("l_suppkey").alias("sample"), context.alias("context")).groupBy("sample", "context").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS sample, " + ", ".join(f"count(*) FILTER ({s} AND {b}) AS {n}" for n, s, b in (("snv_biallelic", "l_linenumber < 5", "l_quantity > 40"), ("snv_other", "l_linenumber < 5", "l_quantity <= 40"), ("indel_biallelic", "l_linenumber >= 5", "l_quantity > 40"), ("indel_other", "l_linenumber >= 5", "l_quantity <= 40"))) + " FROM lineitem GROUP BY 1")
def mutational_loads(spark, sf_dir):
    return X.mutational_loads(items(spark, sf_dir, F.col("l_suppkey").alias("sample"), (F.col("l_linenumber") < 5).alias("snv"), (F.col("l_quantity") > 40).alias("biallelic")))


@query("""WITH o AS (SELECT l_partkey AS gene, l_returnflag AS impact, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT p_partkey AS gene, f AS impact, (p_size % 7) * 0.6::DOUBLE AS ratio FROM part, unnest(['A', 'N']) AS u(f)), b AS (SELECT o.*, CASE WHEN ratio > 1 THEN (ratio - 1) / ratio ELSE 0 END AS p FROM o LEFT JOIN r USING (gene, impact))
SELECT gene, impact, round(n * p, 8) AS drivers, round(n * (1 - p), 8) AS passengers, round(p, 8) AS probability FROM b""")
def driver_counts(spark, sf_dir):
    o = items(spark, sf_dir, F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("impact")).groupBy("gene", "impact").agg(F.count("*").alias("n"))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.explode(F.array(F.lit("A"), F.lit("N"))).alias("impact"), ((F.col("p_size") % 7) * 0.6).alias("ratio"))
    return X.driver_counts(o, r).select("gene", "impact", *[F.round(x, 8).alias(x) for x in ("drivers", "passengers", "probability")])


@query("""WITH o AS (SELECT l_suppkey AS s, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL), f AS (SELECT l_suppkey AS s, l_linenumber + 1 AS b, sum(l_discount * 20) AS n FROM lineitem GROUP BY ALL), j AS (SELECT coalesce(o.s, f.s) AS s, coalesce(o.n, 0) AS o, coalesce(f.n, 0) AS f FROM o FULL JOIN f ON o.s = f.s AND o.b = f.b)
SELECT s AS sample, sum(o)::BIGINT AS total, round(sum(greatest(0, f - o)), 6) AS excess, round(sum(greatest(0, o - f)), 6) AS unallocated, round((sum(greatest(0, f - o)) + sum(greatest(0, o - f))) / sum(o), 6) AS share FROM j GROUP BY 1""")
def signature_residuals(spark, sf_dir):
    c = F.col
    o = items(spark, sf_dir, c("l_suppkey").alias("sample"), c("l_linenumber").alias("b")).groupBy("sample", "b").agg(F.count("*").alias("n"))
    f = items(spark, sf_dir, c("l_suppkey").alias("sample"), (c("l_linenumber") + 1).alias("b"), (c("l_discount") * 20).alias("x")).groupBy("sample", "b").agg(F.sum("x").alias("n"))
    return X.residuals(o, f, ["sample"], "b").select("sample", "total", *[F.round(x, 6).alias(x) for x in ("excess", "unallocated", "share")])


@query()
def simulated_counts(spark, sf_dir):
    means = items(spark, sf_dir, "l_returnflag", "l_linestatus", "l_quantity").groupBy(F.concat("l_returnflag", "l_linestatus").alias("bucket")).agg(F.avg("l_quantity").alias("mean"))
    return X.simulated(means, 200)


@query("""WITH s AS (SELECT l_suppkey AS s, l_linenumber AS b, sum(l_quantity) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_returnflag AS p, l_linenumber AS b, sum(l_quantity) AS n FROM lineitem GROUP BY ALL), a AS (SELECT s, sqrt(sum(n * n)) AS a FROM s GROUP BY 1), b AS (SELECT p, sqrt(sum(n * n)) AS b FROM p GROUP BY 1), d AS (SELECT s, p, sum(s.n * p.n) AS d FROM s JOIN p USING (b) GROUP BY ALL)
SELECT s AS sample, p AS profile, round(d / a / b, 8) AS cosine FROM d JOIN a USING (s) JOIN b USING (p)""")
def profile_similarity(spark, sf_dir):
    c = F.col
    of = lambda k, name: items(spark, sf_dir, c(k).alias(name), c("l_linenumber").alias("b"), "l_quantity").groupBy(name, "b").agg(F.sum("l_quantity").alias("n"))
    return X.profile_similarity(of("l_suppkey", "sample"), of("l_returnflag", "profile"), "b").withColumn("cosine", F.round("cosine", 8))


#: A stated small model: (class, feature, weight).
WEIGHTS = [("breast", "", 0.1), ("breast", "A", 0.02), ("breast", "N", -0.01), ("lung", "", -0.2), ("lung", "R", 0.03), ("skin", "", 0.0), ("skin", "N", 0.015)]


@query(f"""WITH f AS (SELECT l_suppkey AS s, l_returnflag AS f, sum(l_quantity) / 100 AS v FROM lineitem GROUP BY ALL), w(c, f, w) AS (VALUES {", ".join(map(repr, WEIGHTS))}), e AS (SELECT s, b.c, exp(b.w + coalesce((SELECT sum(f.v * w.w) FROM f JOIN w ON f.f = w.f WHERE f.s = x.s AND w.c = b.c), 0)) AS e FROM (SELECT DISTINCT s FROM f) x, (SELECT c, w FROM w WHERE f = '') b WHERE NOT (b.c = 'breast' AND s % 2 = 0)),
t AS (SELECT s, sum(e) AS t FROM e GROUP BY 1) SELECT x.s AS sample, b.c AS "class", round(coalesce(e / t, 0), 8) AS probability FROM (SELECT DISTINCT s FROM f) x CROSS JOIN (SELECT c FROM w WHERE f = '') b LEFT JOIN e ON e.s = x.s AND e.c = b.c JOIN t ON t.s = x.s""")
def tissue_classifier(spark, sf_dir):
    f = items(spark, sf_dir, F.col("l_suppkey").alias("sample"), F.col("l_returnflag").alias("feature"), "l_quantity").groupBy("sample", "feature").agg((F.sum("l_quantity") / 100).alias("value"))
    w = spark.createDataFrame(WEIGHTS, "class string, feature string, weight double")
    no = f.select("sample").distinct().filter("sample % 2 = 0").withColumn("class", F.lit("breast"))
    return X.softmax_scores(f, w, "sample", no).withColumn("probability", F.round("probability", 8))


#: Two stated small trees.
TREES = pd.DataFrame([(0, 0, "q", 25.0, 1, 2, 0.0), (0, 1, "", 0.0, 0, 0, 0.2), (0, 2, "d", 0.05, 3, 4, 0.0), (0, 3, "", 0.0, 0, 0, 0.6), (0, 4, "", 0.0, 0, 0, 0.9), (1, 0, "n", 3.0, 1, 2, 0.0), (1, 1, "", 0.0, 0, 0, 0.1), (1, 2, "", 0.0, 0, 0, 0.7)], columns=["tree", "node", "feature", "threshold", "left", "right", "value"])


@query("""WITH f AS (SELECT l_orderkey, max(l_quantity) AS q, avg(l_discount) AS d, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, (CASE WHEN q <= 25 THEN 0.2 WHEN d <= 0.05 THEN 0.6 ELSE 0.9 END + CASE WHEN n <= 3 THEN 0.1 ELSE 0.7 END) / 2 AS s FROM f)
SELECT l_orderkey, round(s, 8) AS score, round(CASE WHEN s <= 0.2 THEN 0.05 WHEN s >= 0.8 THEN 0.95 WHEN s < 0.5 THEN 0.05 + (s - 0.2) * ((0.5 - 0.05) / 0.3) ELSE 0.5 + (s - 0.5) * ((0.95 - 0.5) / (0.8 - 0.5)) END, 6) AS calibrated FROM s""")
def forest_classifier(spark, sf_dir):
    rows = placed(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "__file", "__row")
    f = aggregated(rows, ["l_orderkey"], ["__file", "__row"], q=F.max("l_quantity"), d=F.avg("l_discount"), n=F.count("*"))
    out = X.forest_scores(f, ["q", "d", "n"], TREES)
    return out.select("l_orderkey", F.round("score", 8).alias("score"), F.round(X.isotonic(F.col("score"), [(0.2, 0.05), (0.5, 0.5), (0.8, 0.95)]), 6).alias("calibrated"))


@query("SELECT sample, 'COVERAGE' AS category, feature, value FROM (SELECT s_suppkey AS sample, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (value FOR feature IN (nation, balance))")
def sample_features(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return X.long_features(s, "sample", "COVERAGE", ["nation", "balance"])


@query("""WITH c AS (SELECT l_suppkey AS s, l_linenumber * 5 AS depth, sum(l_quantity)::BIGINT AS bases FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(bases) OVER (PARTITION BY s ORDER BY depth) AS c, sum(bases) OVER (PARTITION BY s) AS t FROM c)
SELECT s, round(sum(depth * bases) / sum(bases), 8) AS mean, min(depth) FILTER (c * 2 >= t) AS median, round(sum(bases) FILTER (depth >= 10) / sum(bases), 8) AS share_10, round(coalesce(sum(bases) FILTER (depth >= 30), 0) / sum(bases), 8) AS share_30 FROM w GROUP BY 1""")
def coverage_summary(spark, sf_dir):
    c = items(spark, sf_dir, F.col("l_suppkey").alias("s"), (F.col("l_linenumber") * 5).alias("depth"), "l_quantity").groupBy("s", "depth").agg(F.sum("l_quantity").cast("long").alias("bases"))
    return X.coverage_summary(c, ["s"], [10, 30]).select("s", F.round("mean", 8).alias("mean"), "median", F.round("share_10", 8).alias("share_10"), F.round("share_30", 8).alias("share_30"))


@query("""WITH f AS (SELECT l_suppkey AS s, l_returnflag AS k, l_orderkey * 10 + l_linenumber AS name, l_partkey % 50 = 0 AS r, l_discount AS p FROM lineitem) SELECT s, k, name FROM f QUALIFY r OR row_number() OVER (PARTITION BY s, k, r ORDER BY p DESC, name) <= 5""")
def report_selection(spark, sf_dir):
    c = F.col
    f = items(spark, sf_dir, c("l_suppkey").alias("s"), c("l_returnflag").alias("kind"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("name"), (c("l_partkey") % 50 == 0).alias("reported"), c("l_discount").alias("likelihood"))
    return X.report_rows(f, "s", 5).select("s", c("kind").alias("k"), "name")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey AS taxid, l_suppkey % 7 AS genus, 100 + l_partkey % 9 AS species, l_linenumber - 1 AS i, l_discount * 900 AS covered, l_quantity AS depth, CASE WHEN l_tax > 0.06 THEN 'LOW_VIRAL_COVERAGE' ELSE 'NO_ABNORMALITIES' END AS qc, l_orderkey % 5 > 0 AS ok FROM lineitem),
s(species, interp, lk, il, ol) AS (VALUES (100, 'HPV', 'HIGH', NULL, 20), (101, 'EBV', 'LOW', 30, 50), (102, 'MCV', 'HIGH', NULL, NULL)), r AS (SELECT v.*, s.*  EXCLUDE (species), coalesce(s.species IS NOT NULL AND (CASE WHEN i >= 1 THEN il ELSE ol END IS NULL OR (ok AND covered > CASE WHEN i >= 1 THEN il ELSE ol END AND depth > 12)) AND qc <> 'LOW_VIRAL_COVERAGE', false) AS rep FROM v LEFT JOIN s ON v.species = s.species)
SELECT l_orderkey, l_linenumber, p_name AS name, interp AS interpretation, rep AS reported, CASE WHEN rep THEN lk ELSE 'UNKNOWN' END AS likelihood, species = 105 AS blacklisted, CASE WHEN ok THEN 12.0::DOUBLE END AS expected_clonal FROM r LEFT JOIN part ON taxid = p_partkey""")
def virus_calls(spark, sf_dir):
    c = F.col
    v = items(spark, sf_dir, "l_orderkey", "l_linenumber", c("l_partkey").alias("taxid"), (c("l_suppkey") % 7).alias("genus"), (100 + c("l_partkey") % 9).alias("species"), (c("l_linenumber") - 1).alias("integrations"), (c("l_discount") * 900).alias("covered"), c("l_quantity").alias("depth"), F.when(c("l_tax") > 0.06, "LOW_VIRAL_COVERAGE").otherwise("NO_ABNORMALITIES").alias("qc"))
    s = spark.createDataFrame([(100, "HPV", "HIGH", None, 20), (101, "EBV", "LOW", 30, 50), (102, "MCV", "HIGH", None, None)], "species long, interpretation string, likelihood string, integrated_least int, other_least int")
    names = table(spark, sf_dir, "part").select(c("p_partkey").alias("taxid"), c("p_name").alias("name"))
    out = X.virus_calls(v, s, spark.createDataFrame([(105,)], "taxid long"), names, F.lit(12.0), c("l_orderkey") % 5 > 0)
    return out.select("l_orderkey", "l_linenumber", "name", "interpretation", "reported", "likelihood", "blacklisted", "expected_clonal")


@query(f"""WITH d AS (SELECT DISTINCT o_orderkey // 3 AS gene, o_orderstatus AS kind, o_custkey AS c, {DAY.format('o_orderdate')} AS a, {DAY.format('o_orderdate')} + 20 AS b FROM orders WHERE o_orderkey % 3 = 0), k AS (SELECT o_orderkey % 50 AS cluster, o_custkey AS c, {DAY.format('o_orderdate')} AS p FROM orders WHERE o_orderkey % 3 <> 0),
h AS (SELECT gene, kind, cluster, greatest(0, a - p, p - b) AS g FROM d JOIN k ON d.c = k.c AND p BETWEEN a - 512 AND b + 512), m AS (SELECT gene, kind, arg_min(cluster, g * 1000 + cluster) AS cluster FROM h GROUP BY ALL) SELECT DISTINCT d.gene, d.kind, m.cluster FROM d LEFT JOIN m USING (gene, kind)""")
def driver_clusters(spark, sf_dir):
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), days("o_orderdate")
    a = o.filter(k % 3 == 0).select(F.floor(k / 3).alias("gene"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("chromosome"), d.alias("start"), (d + 20).alias("end"))
    b = o.filter(k % 3 != 0).select((k % 50).alias("cluster"), F.col("o_custkey").alias("chromosome"), d.alias("position"))
    return X.cluster_drivers(a, b, 128)


@query("SELECT l_partkey, l_linenumber, count(DISTINCT l_suppkey) AS samples, round(count(DISTINCT l_suppkey) / 100.0::DOUBLE, 8) AS share FROM lineitem GROUP BY ALL")
def sv_cohort_frequency(spark, sf_dir):
    return X.variant_frequency(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber"], "l_suppkey", 100).withColumn("share", F.round("share", 8))

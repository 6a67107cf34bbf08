"""Fusions, junctions and expression: an item stands for a fragment or fusion, parts for genes, suppliers for samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as C
from ..operators import rna as R
from ..storage import table
from .registry import days, query
from .sv_queries import listed, pick

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"
JUNCTION = ["KNOWN", "CANONICAL", "UNKNOWN"]
_TIER = "CASE tier WHEN 'KNOWN' THEN {} WHEN 'SPLICE_SPLICE' THEN {} WHEN 'SPLICE_CANONICAL' THEN {} WHEN 'CANONICAL' THEN {} ELSE {} END"


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey % 13 = 0 AS kp, l_partkey % 5 = 0 AS kg, ['KNOWN', 'CANONICAL', 'UNKNOWN'][1 + l_partkey % 3] AS u, ['KNOWN', 'CANONICAL', 'UNKNOWN'][1 + l_suppkey % 3] AS d, l_quantity / 4 AS n, l_discount / 5 AS au, l_tax / 5 AS ad, l_suppkey % 40 AS xu, l_partkey % 50 AS xd, l_linenumber AS cohort FROM lineitem),
t AS (SELECT *, CASE WHEN kp THEN 'KNOWN' WHEN u = 'KNOWN' AND d = 'KNOWN' THEN 'SPLICE_SPLICE' WHEN u <> 'UNKNOWN' AND d <> 'UNKNOWN' AND u <> d THEN 'SPLICE_CANONICAL' WHEN u = 'CANONICAL' AND d = 'CANONICAL' THEN 'CANONICAL' ELSE 'OTHER' END AS tier FROM f),
g AS (SELECT *, {listed({
    'min_fragment_support': "n < CASE WHEN tier = 'KNOWN' AND NOT (u <> 'UNKNOWN' AND d <> 'UNKNOWN' AND (u = 'KNOWN' OR d = 'KNOWN')) THEN 4 ELSE " + _TIER.format(2, 2, 3, 4, 10) + " END",
    'min_af': 'least(au, ad) < ' + _TIER.format(0, 0.002, 0.005, 0.005, 0.05), 'min_anchor': 'least(xu, xd) < ' + _TIER.format(0, 20, 20, 20, 20), 'max_cohort_frequency': "tier <> 'KNOWN' AND cohort > CASE WHEN kg THEN 5 ELSE 2 END"})} AS f FROM t)
SELECT l_orderkey, l_linenumber, tier, CASE WHEN f = '' THEN 'PASS' ELSE f END AS filters FROM g""")
def fusion_tiers(spark, sf_dir):
    c = F.col
    f = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_partkey") % 13 == 0).alias("known_pair"), (c("l_partkey") % 5 == 0).alias("known_gene"), pick(JUNCTION, c("l_partkey") % 3).alias("up_type"), pick(JUNCTION, c("l_suppkey") % 3).alias("down_type"), (c("l_quantity") / 4).alias("fragments"),
        (c("l_discount") / 5).alias("af_up"), (c("l_tax") / 5).alias("af_down"), (c("l_suppkey") % 40).alias("anchor_up"), (c("l_partkey") % 50).alias("anchor_down"), c("l_linenumber").alias("cohort"),
    )
    return R.fusion_filters(f).select("l_orderkey", "l_linenumber", "tier", "filters")


@query("""WITH g AS (SELECT l_partkey AS j, count(*) FILTER (l_linenumber % 3 = 0) AS split, count(*) FILTER (l_linenumber % 3 = 1) AS realigned, count(*) FILTER (l_linenumber % 3 = 2) AS discordant, max(l_suppkey % 60)::BIGINT AS max_anchor_up, max(l_orderkey % 60)::BIGINT AS max_anchor_down, max(l_quantity) AS u, max(l_suppkey % 30) AS d FROM lineitem GROUP BY 1)
SELECT j, split, realigned, discordant, max_anchor_up, max_anchor_down, round(CASE WHEN u > 0 THEN (split + realigned) / u::DOUBLE ELSE 0 END, 8) AS af_up, round(CASE WHEN d > 0 THEN (split + realigned) / d::DOUBLE ELSE 0 END, 8) AS af_down FROM g""")
def fusion_support(spark, sf_dir):
    c = F.col
    f = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("j"), pick(["SPLIT", "REALIGNED", "DISCORDANT"], c("l_linenumber") % 3).alias("kind"), (c("l_suppkey") % 60).alias("anchor_up"), (c("l_orderkey") % 60).alias("anchor_down"), c("l_quantity").alias("depth_up"), (c("l_suppkey") % 30).alias("depth_down"))
    return R.fusion_support(f, ["j"]).withColumns({"af_up": F.round("af_up", 8), "af_down": F.round("af_down", 8)})


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS gu, o_custkey + 1 AS gd, {DAY.format('o_orderdate')} AS pu, {DAY.format('o_orderdate')} + 400 AS pd FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey // 4 AS sv, o_custkey AS gene, {DAY.format('o_orderdate')} AS p, o_orderkey % 4 < 2 AS up FROM orders UNION ALL SELECT o_orderkey // 4, o_custkey + 1, {DAY.format('o_orderdate')} + 200, o_orderkey % 4 >= 2 FROM orders)
SELECT r.id, arg_min(x.sv, (x.p - pu + pd - y.p) * 1000000000 + x.sv) AS sv FROM r LEFT JOIN (b x JOIN b y ON x.sv = y.sv AND x.up AND NOT y.up) ON x.gene = gu AND y.gene = gd AND x.p BETWEEN pu AND pu + 300 AND y.p BETWEEN pd - 300 AND pd GROUP BY 1""")
def rna_fusion_match(spark, sf_dir):
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), days("o_orderdate")
    r = o.filter(k % 2 == 0).select(k.alias("id"), F.col("o_custkey").alias("gene_up"), (F.col("o_custkey") + 1).alias("gene_down"), d.alias("position_up"), (d + 400).alias("position_down"))
    sv = F.floor(k / 4).alias("sv")
    b = o.select(sv, F.col("o_custkey").alias("gene"), d.alias("position"), (k % 4 < 2).alias("upstream")).union(o.select(sv, F.col("o_custkey") + 1, d + 200, k % 4 >= 2))
    return R.rna_matched(r, b, 300, 512).select("id", "sv")


@query(f"""WITH a AS (SELECT o_orderkey AS id, o_custkey AS k, {DAY.format('o_orderdate')} AS u, {DAY.format('o_orderdate')} + o_orderkey % 80 AS d FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS id, o_custkey AS k, {DAY.format('o_orderdate')} AS u, {DAY.format('o_orderdate')} + o_orderkey % 70 AS d FROM orders WHERE o_orderkey % 2 = 1),
h AS (SELECT a.id, b.id AS o, abs(a.u - b.u) + abs(a.d - b.d) AS g FROM a JOIN b ON a.k = b.k AND abs(a.u - b.u) <= 50 AND abs(a.d - b.d) <= 50), m AS (SELECT id, arg_min(o, g * 1000000000 + o) AS o FROM h GROUP BY 1)
SELECT a.id, m.o AS other_id FROM a LEFT JOIN m USING (id) UNION ALL SELECT NULL, id FROM b WHERE id NOT IN (SELECT o FROM h)""")
def external_fusions(spark, sf_dir):
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), days("o_orderdate")
    a = o.filter(k % 2 == 0).select(k.alias("id"), F.col("o_custkey").alias("k"), d.alias("up"), (d + k % 80).alias("down"))
    b = o.filter(k % 2 == 1).select(k.alias("other_id"), F.col("o_custkey").alias("k"), d.alias("up"), (d + k % 70).alias("down"))
    return R.matched_externally(a, b, ["k"], 50, 128)


@query(f"""WITH v AS (SELECT o_orderkey AS id, o_custkey AS k, {DAY.format('o_orderdate')} AS p FROM orders WHERE o_orderkey % 3 = 0), j AS (SELECT DISTINCT o_custkey AS k, {DAY.format('o_orderdate')} - 40 AS a, {DAY.format('o_orderdate')} + 40 AS b, o_orderkey % 9 AS n FROM orders WHERE o_orderkey % 3 <> 0)
SELECT id, count(*) AS junctions, sum(n)::BIGINT AS fragments FROM v JOIN j ON v.k = j.k AND (abs(p - a) <= 30 OR abs(p - b) <= 30) GROUP BY 1""")
def splice_variant_match(spark, sf_dir):
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), days("o_orderdate")
    v = o.filter(k % 3 == 0).select(k.alias("id"), F.col("o_custkey").alias("k"), d.alias("position"))
    j = o.filter(k % 3 != 0).select(F.col("o_custkey").alias("k"), (d - 40).alias("start"), (d + 40).alias("end"), (k % 9).alias("fragments"))
    return R.splice_variant_matches(v, j, ["k"], 30, 128)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 20 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 = 0)")
def junction_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return R.junction_filter(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", 20, p.filter("p_size > 20"), p.filter("l_partkey % 7 = 0")).select("l_orderkey", "l_linenumber")


@query("""WITH f AS (SELECT l_partkey % 50 AS g, l_suppkey % 40 AS a, l_orderkey % 40 AS b FROM lineitem), k AS (SELECT l_partkey % 50 AS g, l_linenumber AS t, l_suppkey % 20 AS a, 20 + l_orderkey % 12 AS b FROM lineitem WHERE l_quantity > 40),
c AS (SELECT g, a, b, count(*) AS n FROM f GROUP BY ALL), w AS (SELECT c.*, EXISTS (SELECT 1 FROM k WHERE k.g = c.g AND k.a = c.a) AS s, EXISTS (SELECT 1 FROM k WHERE k.g = c.g AND k.b = c.b) AS e,
EXISTS (SELECT 1 FROM k x JOIN k y ON x.g = y.g AND x.t = y.t WHERE x.g = c.g AND x.a = c.a AND y.b = c.b) AS same FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.g = c.g AND k.a = c.a AND k.b = c.b))
SELECT g, a AS start, b AS "end", n AS fragments, CASE WHEN b < a THEN 'CIRCULAR' WHEN s AND e AND same THEN 'SKIPPED_EXON' WHEN s AND e THEN 'MIXED_TRANSCRIPT' WHEN s THEN 'NOVEL_3_PRIME_SS' WHEN e THEN 'NOVEL_5_PRIME_SS' WHEN a % 5 = 0 THEN 'NOVEL_INTRON' WHEN a % 2 = 0 AND b % 2 = 0 THEN 'INTRONIC' WHEN a % 2 <> b % 2 THEN 'INTRONIC_TO_EXONIC' ELSE 'EXONIC' END AS type FROM w""")
def novel_junctions(spark, sf_dir):
    c = F.col
    i = table(spark, sf_dir, "lineitem")
    region = lambda x: F.when(x % 2 == 0, "INTRONIC").otherwise("EXONIC")
    a, b = c("l_suppkey") % 40, c("l_orderkey") % 40
    f = i.select((c("l_partkey") % 50).alias("g"), a.alias("start"), b.alias("end"), region(a).alias("start_region"), region(b).alias("end_region"), (a % 5 == 0).alias("one_exon"))
    k = i.filter("l_quantity > 40").select((c("l_partkey") % 50).alias("g"), c("l_linenumber").alias("transcript"), (c("l_suppkey") % 20).alias("start"), (20 + c("l_orderkey") % 12).alias("end"))
    return R.novel_junctions(f, k, ["g"])


@query(f"""WITH r AS (SELECT o_custkey AS c, {DAY.format('o_orderdate')} AS a, {DAY.format('o_orderdate')} + 200 AS b, o_orderkey % 11 = 0 AS spliced FROM orders), e AS (SELECT DISTINCT c_custkey AS c, 8800 + 100 * k AS p FROM customer, unnest(generate_series(0, 16)) AS u(k))
SELECT e.c, p AS boundary, count(*) AS reads, count(*) FILTER (spliced) AS spliced FROM r JOIN e ON r.c = e.c AND a <= p AND b >= p + 1 GROUP BY ALL HAVING count(*) >= 3 OR count(*) FILTER (spliced) >= 1""")
def retained_introns(spark, sf_dir):
    o, d = table(spark, sf_dir, "orders"), days("o_orderdate")
    r = o.select(F.col("o_custkey").alias("c"), d.alias("start"), (d + 200).alias("end"), (F.col("o_orderkey") % 11 == 0).alias("spliced"))
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.explode(F.array(*[F.lit(8800 + 100 * i).cast("long") for i in range(17)])).alias("boundary"))
    return R.retained_introns(r, e, ["c"], 3, 128)


@query("""WITH o AS (SELECT l_partkey % 101 AS b, count(*) AS n FROM lineitem GROUP BY 1), x AS (SELECT p_partkey AS t, (p_partkey + p_size) % 101 AS b, p_retailprice AS s FROM part), e AS (SELECT b, sum(s) AS s FROM x GROUP BY 1), r AS (SELECT coalesce(o.b, e.b) AS b, CASE WHEN coalesce(s, 0) > 0 THEN (coalesce(n, 0) / (SELECT sum(n) FROM o)) / (s / (SELECT sum(s) FROM e)) ELSE 1 END AS r FROM o FULL JOIN e ON o.b = e.b)
SELECT t % 40 AS transcript, round(sum(s * coalesce(r, 1)) / sum(s), 6) AS factor FROM x LEFT JOIN r USING (b) GROUP BY 1""")
def gc_reestimated(spark, sf_dir):
    c = F.col
    o = table(spark, sf_dir, "lineitem").groupBy((c("l_partkey") % 101).alias("bucket")).agg(F.count("*").alias("n"))
    x = table(spark, sf_dir, "part").select((c("p_partkey") % 40).alias("transcript"), ((c("p_partkey") + c("p_size")) % 101).alias("bucket"), c("p_retailprice").alias("share"))
    return R.reestimated_rates(x, R.gc_adjusted(o, x)).withColumn("factor", F.round("factor", 6))


@query("""WITH p AS (SELECT l_suppkey AS s, l_partkey % 60 AS g, avg(l_quantity) AS t FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), w AS (SELECT l_suppkey AS s, l_partkey % 60 AS g, avg(l_quantity) AS t FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
f AS (SELECT g, median(p.t / w.t) AS f FROM p JOIN w USING (s, g) WHERE w.t > 0 GROUP BY 1) SELECT s AS sample, g AS gene, round(CASE WHEN f > 0 AND t > 0 THEN t / f ELSE t END, 6) AS tpm FROM p LEFT JOIN f USING (g)""")
def panel_tpm(spark, sf_dir):
    c = F.col
    i = table(spark, sf_dir, "lineitem")
    of = lambda x: i.filter(c("l_linestatus") == x).groupBy(c("l_suppkey").alias("sample"), (c("l_partkey") % 60).alias("gene")).agg(F.avg("l_quantity").alias("tpm"))
    p, w = of("O"), of("F")
    return R.panel_normalised(p, R.panel_factors(p, w, "gene", "tpm"), "gene", "tpm").select("sample", "gene", F.round("tpm", 6).alias("tpm"))


@query("SELECT l_suppkey AS sample, l_partkey AS site, count(*) FILTER (l_linestatus = 'O') AS spliced, count(*) FILTER (l_linestatus = 'F') AS unspliced, round(count(*) FILTER (l_linestatus = 'O') / count(*) FILTER (l_linestatus IN ('O', 'F'))::DOUBLE, 8) AS usage FROM lineitem GROUP BY ALL")
def splice_usage(spark, sf_dir):
    c = F.col
    i = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("sample"), c("l_partkey").alias("site"), (c("l_linestatus") == "O").cast("long").alias("spliced"), (c("l_linestatus") == "F").cast("long").alias("unspliced"))
    return R.site_usage(i, ["sample"]).withColumn("usage", F.round("usage", 8))


@query(f"""WITH r AS (SELECT l_orderkey AS f, l_suppkey % 3 AS c, {DAY.format('l_shipdate')} * 10000 AS a, {DAY.format('l_shipdate')} * 10000 + 100 AS b, l_linenumber % 2 = 1 AS fwd, l_partkey % 31 = 0 AS supp, l_partkey * 300 AS skip FROM lineitem WHERE l_linenumber <= 2),
g AS (SELECT f, bool_or(supp OR skip > 500000) AS s, count(DISTINCT c) AS c, max(b) - min(a) AS w, count(*) FILTER (fwd) AS k, count(*) AS n FROM r GROUP BY 1) SELECT f AS fragment, CASE WHEN s THEN 'SPLIT' ELSE 'DISCORDANT' END AS kind FROM g WHERE s OR c > 1 OR w > 500000 OR (n = 2 AND k <> 1)""")
def chimeric_reads(spark, sf_dir):
    c, d = F.col, days("l_shipdate") * 10000
    r = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(c("l_orderkey").alias("fragment"), (c("l_suppkey") % 3).alias("chromosome"), d.alias("start"), (d + 100).alias("end"), (c("l_linenumber") % 2 == 1).alias("forward"), (c("l_partkey") % 31 == 0).alias("supplementary"), (c("l_partkey") * 300).alias("skipped"))
    return R.chimeric_reads(r)


@query("""WITH a AS (SELECT l_partkey AS g, avg(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_partkey AS g, avg(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT coalesce(a.g, b.g) AS gene, CASE WHEN b.g IS NULL THEN 'OWN_ONLY' WHEN a.g IS NULL THEN 'OTHER_ONLY' WHEN abs(a.v - b.v) > 0.3 * greatest(abs(a.v), abs(b.v)) THEN 'DIFF' ELSE 'MATCH' END AS status FROM a FULL JOIN b ON a.g = b.g""")
def expression_compare(spark, sf_dir):
    of = lambda x: table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == x).groupBy(F.col("l_partkey").alias("gene")).agg(F.avg("l_quantity").alias("v"))
    return R.expression_compared(of("O"), of("F"), ["gene"], "v", 0.3)


@query("SELECT l_partkey AS junction, " + ", ".join(f"coalesce(sum(l_quantity) FILTER (l_suppkey % 5 = {i}), 0) AS s{i}" for i in range(5)) + " FROM lineitem GROUP BY 1")
def junction_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("junction"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("sample"), "l_quantity")
    return C.wide(rows, "junction", "sample", "l_quantity", [f"s{i}" for i in range(5)])

"""What surrounds the purity fit: an order's or item's numbers stand for ratios, depths and frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import purityfit as P
from ..storage import table
from .registry import days, query
from .sv_queries import pick

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber - 1 > 0 AND l_quantity / 14 <= 3 AND ['DIPLOID', 'HET_DELETION', 'NOISE'][1 + l_partkey % 3] = 'DIPLOID' AND l_suppkey % 24 < 22")
def fitting_regions(spark, sf_dir):
    c = F.col
    ok = P.usable_region(c("l_linenumber") - 1, c("l_quantity") / 14, pick(["DIPLOID", "HET_DELETION", "NOISE"], c("l_partkey") % 3), c("l_suppkey") % 24 < 22)
    return table(spark, sf_dir, "lineitem").filter(ok).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, round(l_discount / l_tax, 8) AS baf FROM lineitem WHERE l_quantity >= 8 AND l_linenumber <= 0.1 * l_quantity AND l_tax > 0")
def baf_sites(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").withColumn("baf", F.when(c("l_tax") > 0, c("l_discount") / c("l_tax")).otherwise(F.lit(float("nan"))))
    return rows.filter(P.usable_site(c("l_quantity"), c("l_linenumber"), c("baf"), 8, 0.1)).select("l_orderkey", "l_linenumber", F.round("baf", 8).alias("baf"))


@query("""WITH d AS (SELECT DISTINCT 10 + l_linenumber * 9 AS d FROM lineitem), n AS (SELECT d, n FROM d, unnest(generate_series(d // 2, d * 3 // 2 - 1)) AS u(n)), k AS (SELECT d, n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + n * ln(0.5))) OVER (PARTITION BY d, n ORDER BY k) AS c FROM n, unnest(generate_series(0, n)) AS u(k)),
q AS (SELECT d, n, min(k) AS k FROM k WHERE c >= 0.8 GROUP BY ALL) SELECT d::BIGINT AS depth, round(greatest(avg(k / n::DOUBLE), 0.535), 8) AS baf FROM q GROUP BY 1""")
def expected_baf(spark, sf_dir):
    depths = table(spark, sf_dir, "lineitem").select((10 + F.col("l_linenumber") * 9).cast("long").alias("depth")).distinct()
    return P.with_expected_baf(depths, "depth").withColumn("baf", F.round("baf", 8))


@query(f"""WITH w AS (SELECT o_custkey AS c, {DAY.format('o_orderdate')} AS p, avg(o_totalprice) AS d, max(o_orderkey) AS r FROM orders GROUP BY ALL) SELECT c, p, round(d, 4) AS tumor_depth, (r % 7)::DOUBLE AS tumor_ratio, round(d / 2, 4) AS reference_depth, (r % 5)::DOUBLE AS reference_ratio FROM w""")
def ratio_merge(spark, sf_dir):
    w = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c"), days("o_orderdate").alias("p")).agg(F.avg("o_totalprice").alias("d"), F.max("o_orderkey").alias("r"))
    t = w.select("c", "p", F.round("d", 4).alias("depth"), (F.col("r") % 7).cast("double").alias("ratio"))
    r = w.select("c", "p", F.round(F.col("d") / 2, 4).alias("depth"), (F.col("r") % 5).cast("double").alias("ratio"))
    return P.collated(t, r, ["c", "p"], ["depth", "ratio"])


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS k, {DAY.format('o_orderdate')} * 100000 + o_orderkey AS s, CASE WHEN o_orderkey % 4 = 0 THEN 'SV' ELSE 'NONE' END AS support, CASE WHEN o_orderkey % 3 = 0 THEN 'DIPLOID' ELSE 'NOISE' END AS status FROM orders)
SELECT id, CASE WHEN support = 'NONE' AND status = 'DIPLOID' THEN least(s, coalesce((SELECT min(q.s) FROM r q WHERE q.k = r.k AND q.s < r.s AND q.status <> 'DIPLOID' AND NOT EXISTS (SELECT 1 FROM r z WHERE z.k = r.k AND z.s < r.s AND ((z.s >= q.s AND z.status = 'DIPLOID') OR (z.s > q.s AND z.support <> 'NONE')))), s)) ELSE s END AS extended FROM r""")
def support_extension(spark, sf_dir):
    k = F.col("o_orderkey")
    s = days("o_orderdate") * 100000 + k
    r = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("k"), s.alias("start"), F.when(k % 4 == 0, "SV").otherwise("NONE").alias("support"), F.when(k % 3 == 0, "DIPLOID").otherwise("NOISE").alias("status"), s.alias("min_start"))
    return P.extended_support(r, ["k"]).select("id", "extended")


_REGIONS = "r AS (SELECT l_suppkey AS s, l_orderkey * 10 + l_linenumber AS id, 0.5 + l_discount * 2.5 AS baf, l_partkey % 12 AS n FROM lineitem)"


@query(f"""WITH {_REGIONS}, w AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY baf, n) AS c, sum(n) OVER (PARTITION BY s) AS t FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY s, c >= t * (1 - 0.003) ORDER BY baf, n) AS k FROM w),
g AS (SELECT s, sum(n) FILTER (baf >= 0.57 AND n >= 1) / sum(n)::DOUBLE AS share, bool_or(baf >= 0.7 AND n >= greatest(5, t * 0.003)) AS far, max(struct_pack(baf := baf, n := n, v := 2 * baf - 1)) FILTER (n >= 5 AND baf >= 0.57 AND (c < t * (1 - 0.003) OR k = 1)) AS b FROM p GROUP BY 1)
SELECT s, round(coalesce(share, 0), 8) AS share, coalesce(share, 0) >= 0.008 OR far AS aneuploid, round(b.v, 8) AS implied_purity FROM g""")
def aneuploidy(spark, sf_dir):
    c = F.col
    r = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("s"), (0.5 + c("l_discount") * 2.5).alias("baf"), (c("l_partkey") % 12).alias("count"))
    return P.aneuploidy(r, ["s"]).select("s", F.round("share", 8).alias("share"), "aneuploid", F.round("implied_purity", 8).alias("implied_purity"))


@query(f"""WITH g AS (SELECT o_custkey % 40 AS sample, o_custkey AS k, {DAY.format('min(o_orderdate)')} AS a, {DAY.format('min(o_orderdate)')} + 900 AS b FROM orders GROUP BY ALL), p AS (SELECT o_custkey AS k, {DAY.format('o_orderdate')} AS p, o_totalprice / 400000 AS baf FROM orders),
e AS (SELECT sample, g.k, stddev_samp(baf) AS s, count(*) AS n FROM g JOIN p ON g.k = p.k AND p BETWEEN a AND b GROUP BY ALL HAVING count(*) >= 2) SELECT sample, round(sum(s * n) / sum(n), 8) AS spread, sum(s * n) / sum(n) > 0.08 AS chimeric FROM e GROUP BY 1""")
def chimerism(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = o.groupBy((F.col("o_custkey") % 40).alias("sample"), F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("d")).select("sample", "k", days("d").alias("start"), (days("d") + 900).alias("end"))
    p = o.select(F.col("o_custkey").alias("k"), days("o_orderdate").alias("position"), (F.col("o_totalprice") / 400000).alias("baf"))
    return P.chimerism(g, p, ["k"], 256).withColumn("spread", F.round("spread", 8))


@query("""WITH r AS (SELECT l_suppkey AS s, l_partkey % 30 AS region, sum(l_linenumber) AS a, sum(l_quantity) AS d, count(*) AS n FROM lineitem GROUP BY ALL), f AS (SELECT *, a / d AS af FROM r WHERE a / d < 0.5), w AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY af, region) AS c, sum(n) OVER (PARTITION BY s) AS t FROM f)
SELECT s, count(*) AS regions, sum(n)::BIGINT AS sites, sum(a)::BIGINT AS support, round(min(af) FILTER (c > t // 2), 8) AS median_af FROM w GROUP BY 1""")
def loh_region_af(spark, sf_dir):
    c = F.col
    sites = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("s"), (c("l_partkey") % 30).alias("region"), c("l_linenumber").alias("support"), c("l_quantity").alias("depth"))
    return P.loh_fraction_af(sites, ["s"], "region").withColumn("median_af", F.round("median_af", 8))


LEVELS = P.peak_levels()


@query(f"""WITH e AS (SELECT 20 + l_quantity AS n, least(l_linenumber + l_suppkey % 5, 20 + l_quantity - l_linenumber - l_suppkey % 5) AS k, count(*) AS c FROM lineitem GROUP BY ALL), g AS (SELECT unnest({LEVELS}::DOUBLE[]) AS level),
m AS (SELECT level, c, abs(k / n - level) <= sqrt(level * (1 - level) / n) AS hom, abs(k / n - level / 2) <= sqrt(level / 2 * (1 - level / 2) / n) AS het, k / n > 0.75 * level AS up FROM e, g WHERE n * level / 2 >= 2),
s AS (SELECT level, sum(c)::BIGINT AS tested, coalesce(sum(c) FILTER (hom AND (NOT het OR up)), 0)::BIGINT AS homozygous, coalesce(sum(c) FILTER (het AND NOT (hom AND up)), 0)::BIGINT AS heterozygous FROM m GROUP BY 1),
w AS (SELECT *, (homozygous + heterozygous) / tested::DOUBLE AS score FROM s WHERE homozygous + heterozygous >= 15), l AS (SELECT *, lag(score) OVER (ORDER BY level) AS a, lead(score) OVER (ORDER BY level) AS b FROM w)
SELECT level, tested, homozygous, heterozygous, round(score, 8) AS score FROM l WHERE (a IS NULL OR score > a) AND (b IS NULL OR score >= b)""")
def noise_floor_peaks(spark, sf_dir):
    c = F.col
    e = table(spark, sf_dir, "lineitem").select((20 + c("l_quantity")).alias("n"), (c("l_linenumber") + c("l_suppkey") % 5).alias("k"))
    return P.local_maxima(P.noise_peaks(e, LEVELS), "level", "score").withColumn("score", F.round("score", 8))


@query("""SELECT l_suppkey AS s, round(avg(l_tax) FILTER (l_discount < 0.05), 8) AS low, round(avg(l_tax) FILTER (l_discount >= 0.05), 8) AS high, coalesce(abs(avg(l_tax) FILTER (l_discount < 0.05) - 0.04) <= 0.15 AND abs(avg(l_tax) FILTER (l_discount >= 0.05) - 0.96) <= 0.95, false) AS x FROM lineitem GROUP BY 1""".replace(" AS x FROM", " AS agrees FROM").replace("<= 0.15 AND", "<= 0.95 AND"))
def gnomad_peak_check(spark, sf_dir):
    c = F.col
    p = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("s"), (c("l_discount") * 10).alias("vaf"), c("l_tax").alias("population"))
    return P.frequencies_agree(p, ["s"], F.lit(0.04), 0.95).withColumns({"low": F.round("low", 8), "high": F.round("high", 8)})


@query("""WITH v AS (SELECT l_suppkey AS s, l_linenumber - 1 AS a, l_quantity AS d, 1.0 + l_partkey % 3 AS cn, 0.5 + l_partkey % 2 AS vcn FROM lineitem), t AS (SELECT *, CASE WHEN vcn + 2 * (a / d) - cn * (a / d) > 0 THEN least(2, 2 * (a / d) / (vcn + 2 * (a / d) - cn * (a / d))) ELSE 2 END AS tf FROM v)
SELECT s, round(sum(d * d / cn) / sum(d / cn), 6) AS depth, count(*) FILTER (a = 1) AS one, count(*) FILTER (a >= 2) AS more, sum(d * d / cn) / sum(d / cn) < 50 AND count(*) FILTER (a >= 2) >= greatest(4, 0.005 * count(*)) AS usable, round(median(tf), 8) AS median_tf FROM t GROUP BY 1""")
def low_count_model(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("s"), (c("l_linenumber") - 1).alias("support"), c("l_quantity").alias("depth"), (1.0 + c("l_partkey") % 3).alias("copies"), (0.5 + c("l_partkey") % 2).alias("variant_copies"))
    return P.low_counts(v, ["s"]).withColumns({"depth": F.round("depth", 6), "median_tf": F.round("median_tf", 8)})


@query(f"""WITH g AS (SELECT o_custkey AS k, {DAY.format('o_orderdate')} AS a, {DAY.format('o_orderdate')} + 30 AS b, (o_orderkey % 70) / 10.0::DOUBLE AS cn FROM orders WHERE o_orderkey % 4 = 0), w AS (SELECT o_custkey AS k, o_custkey % 30 AS s, {DAY.format('o_orderdate')} AS p, o_totalprice / 100000 AS r FROM orders)
SELECT s AS sample, floor(cn + 0.5)::INT AS level, count(*) AS windows, round(median(r), 6) AS median FROM w JOIN g ON w.k = g.k AND p BETWEEN a AND b WHERE abs(cn - floor(cn + 0.5)) <= 0.2 AND floor(cn + 0.5) BETWEEN 0 AND 6 GROUP BY ALL""")
def copy_number_profile(spark, sf_dir):
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), days("o_orderdate")
    g = o.filter(k % 4 == 0).select(F.col("o_custkey").alias("k"), d.alias("start"), (d + 30).alias("end"), ((k % 70) / 10).alias("cn"))
    w = o.select(F.col("o_custkey").alias("k"), (F.col("o_custkey") % 30).alias("sample"), d.alias("position"), (F.col("o_totalprice") / 100000).alias("ratio"))
    return P.copy_levels(w, g, ["k"], 128).withColumn("median", F.round("median", 6))


@query("""WITH w AS (SELECT l_suppkey AS sample, l_partkey % 200 AS region, avg(l_quantity - 3) AS ratio FROM lineitem GROUP BY ALL), m AS (SELECT sample, median(ratio) AS m FROM w WHERE ratio > 0 GROUP BY 1)
SELECT region, count(*) AS samples, CASE WHEN median(ratio / m) >= 0.1 AND count(*) FILTER (ratio > 0) * 2 > count(*) THEN round(median(ratio / m), 6) END AS enrichment FROM w JOIN m USING (sample) GROUP BY 1""")
def panel_enrichment(spark, sf_dir):
    c = F.col
    w = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("sample"), (c("l_partkey") % 200).alias("region")).agg(F.avg(c("l_quantity") - 3).alias("ratio"))
    return P.enrichment(w, ["region"]).withColumn("enrichment", F.round("enrichment", 6))


@query()
def subclonal_peaks(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 20).alias("s"), (c("l_linenumber") / 3 + c("l_discount")).alias("copies"), (20 + c("l_quantity")).alias("depth"), F.lit(2.0).alias("purity_copies"))
    return P.subclonal_peaks(v, ["s"]).withColumn("weight", F.round("weight", 6))


@query()
def somatic_readjustment(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "lineitem").select((30 + c("l_quantity")).cast("long").alias("n"), (c("l_linenumber") + F.when(c("l_partkey") % 20 == 0, 20).otherwise(0)).cast("long").alias("k"))
    return spark.createDataFrame([(0.12, P.readjusted_purity(v, 0.12))], "standard double, readjusted double")

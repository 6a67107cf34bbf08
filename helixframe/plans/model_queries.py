"""Models: grid searches, segmentation, components, fits. Those without SQL are tested against brute force in tests/."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth as D
from ..operators import fits as M
from ..operators import graph as G
from ..operators import grids as R
from ..operators import segmentation as S
from ..storage import stored, table
from .depth_queries import LEAST, HOUR, reads
from .interval_queries import spans
from .registry import days, query, seconds

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


@query()
def depth_segments(spark, sf_dir):
    """Depth windows, GC normalisation, unity, then segments of the logarithms under one penalty: the whole first path of a depth file."""
    w = D.window_depth(reads(spark, sf_dir), ["chromosome"], "start", "len", "gcb", HOUR)
    r = D.gc_normalised(w, D.smoothed(D.gc_medians(w), LEAST))
    r = D.unity(D.mean_over_median(r, "ratio", "depth", F.col("ratio") > 0), "ratio", F.lit(True))
    logs = stored(r.select("chromosome", "window", "ratio", S.log_ratio(F.col("ratio")).alias("log")), "ratios")
    cost = S.penalty_of(logs, ["chromosome"], "window", "log", 10.0)
    return S.segmented(logs, ["chromosome"], "window", "log", cost, raw="ratio").withColumn("mean", F.round("mean", 6))


@query()
def pcf_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", seconds().alias("t"), "value")
    return S.segmented(e, ["user_id"], "t", "value", 400.0).withColumn("mean", F.round("mean", 6))


@query(f"""WITH a AS (SELECT DISTINCT o_custkey AS k, {DAY.format('o_orderdate')} AS p FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS k, {DAY.format('o_orderdate')} AS p FROM orders WHERE o_orderkey % 3 <> 0),
u AS (SELECT k, p, min(s) AS s FROM (SELECT *, 0 AS s FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL)
SELECT k, p::BIGINT AS start, (lead(p) OVER w - 1)::BIGINT AS "end", CASE WHEN lag(p) OVER w IS NULL THEN 'TELOMERE' WHEN s = 0 THEN 'SV' ELSE 'PCF' END AS support FROM u WINDOW w AS (PARTITION BY k ORDER BY p)""")
def segment_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), days("o_orderdate").alias("p"))
    return S.union_of_breaks(o.filter("o_orderkey % 3 = 0").select("k", "p"), o.filter("o_orderkey % 3 != 0").select("k", "p"), ["k"], "p")


@query()
def copy_number_smoothing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = spans(spark, sf_dir).join(o.select("o_orderkey", (F.col("o_totalprice") / 100000).alias("cn")), "o_orderkey").withColumn("w", F.col("o_orderkey") % 11)
    return S.smoothed_copy_number(rows, ["k"], "a", "b", "cn", "w", 0.3).withColumn("value", F.round("value", 6))


GRID = """WITH g AS (SELECT round(0.1 + 0.05 * i, 6) AS p, round(1 + 0.1 * j, 6) AS q FROM unnest(generate_series(0, 18)) AS a(i), unnest(generate_series(0, 40)) AS b(j)),
r AS (SELECT l_suppkey, avg(l_quantity) / 25.5 AS ratio, 0.5 + avg(l_discount) AS baf, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1),
t AS (SELECT *, 2.0::DOUBLE / (2 - 2 * p + q * p) AS n FROM g, r), c AS (SELECT *, 2 + 2 * (ratio - n) / p / n AS cn FROM t), m AS (SELECT *, (baf * (p * cn + 2 * (1 - p)) - (1 - p)) / p AS ma FROM c),
x AS (SELECT *, cn - ma AS mi FROM m),
s AS (SELECT p AS purity, q AS ploidy, sum(w * (1 + 0.4 * least(abs(ma - 1) + abs(mi - 1), 1 + abs(ma - 2) + abs(mi - 2)))) / sum(w) *
 sum(w * ((CASE WHEN ma < -0.5 THEN 0.5 + (-0.5 - ma) ELSE abs(ma - floor(ma + 0.5)) END) + (CASE WHEN mi < -0.5 THEN 0.5 + (-0.5 - mi) ELSE abs(mi - floor(mi + 0.5)) END))) / sum(w) AS score FROM x GROUP BY ALL)"""


def scores(spark, sf_dir):
    regions = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.avg("l_quantity") / 25.5).alias("ratio"), (F.avg("l_discount") + 0.5).alias("baf"), F.count("*").cast("double").alias("w"))
    return R.purity_scores(regions, R.purity_grid(spark, 0.1, 1.0, 0.05, [(1.0, 5.0, 0.1)]), "ratio", "baf", "w")


@query(GRID + " SELECT purity::DOUBLE AS purity, ploidy::DOUBLE AS ploidy, round(score, 5) AS score FROM s")
def purity_grid(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("score", F.round("score", 5))


@query(GRID + " SELECT min(purity)::DOUBLE AS min_purity, max(purity)::DOUBLE AS max_purity, min(ploidy)::DOUBLE AS min_ploidy, max(ploidy)::DOUBLE AS max_ploidy, count(*) AS n FROM s WHERE score <= 1.1 * (SELECT min(score) FROM s) OR score <= (SELECT min(score) FROM s) + 0.0005")
def fit_score_range(spark, sf_dir):
    return R.near_best(scores(spark, sf_dir)).agg(F.min("purity").alias("min_purity"), F.max("purity").alias("max_purity"), F.min("ploidy").alias("min_ploidy"), F.max("ploidy").alias("max_ploidy"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT l_linenumber - 1 AS k, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM h), g AS (SELECT i / 20.0::DOUBLE AS level FROM unnest(generate_series(1, 20)) AS u(i)),
m AS (SELECT level, n / t AS o, 0.5 * exp(-level * 4.0) * (level * 4.0) ** k / gamma(k + 1) + 0.25 * exp(-level * 8.0) * (level * 8.0) ** k / gamma(k + 1) + 0.25 * (k = 0)::INT AS m FROM h, t, g)
SELECT level, round(sum(abs(o - m)) + (1 - sum(m)), 6) AS score FROM m GROUP BY 1""")
def contamination_grid(spark, sf_dir):
    sites = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("k")).agg(F.count("*").alias("n"))
    return R.contamination(sites, "k", "n", 8.0, [i / 20 for i in range(1, 21)]).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT CAST(l_quantity AS BIGINT) AS dp, round(l_discount * 2, 3) AS af, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT i / 10.0::DOUBLE AS level, k FROM unnest(generate_series(0, 10)) AS a(i), unnest(generate_series(0, 10)) AS b(k)),
b AS (SELECT level, k, n, dp, least(greatest(level * af, 1e-12), 1 - 1e-12) AS p FROM s, g), m AS (SELECT level, k, sum(n * CASE WHEN k > dp THEN 0 ELSE exp(lgamma(dp + 1) - lgamma(k + 1) - lgamma(dp - k + 1) + k * ln(p) + (dp - k) * ln(1 - p)) END) AS m FROM b GROUP BY ALL),
o AS (SELECT l_linenumber - 1 AS k, count(*) AS o FROM lineitem GROUP BY 1) SELECT level, round(sum(abs(coalesce(o, 0) - m)), 4) AS score FROM m LEFT JOIN o USING (k) GROUP BY 1""")
def tinc_grid(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("dp"), (F.col("l_linenumber") - 1).alias("ad"), (F.col("l_discount") * 2).alias("af"))
    return R.tinc(v, "dp", "ad", "af", [i / 10 for i in range(11)]).withColumn("score", F.round("score", 4))


@query("""WITH RECURSIVE e AS (SELECT user_id AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id // 6 AS o FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY t) > 900 THEN 1 ELSE 0 END AS f FROM e), i AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY t) AS i FROM g),
p AS (SELECT DISTINCT a.o AS a, b.o AS b FROM i a JOIN i b ON a.k = b.k AND a.i = b.i), c(o, r) AS (SELECT DISTINCT o, o FROM e UNION SELECT p.b, c.r FROM c JOIN p ON p.a = c.o)
SELECT o, min(r) AS cluster FROM c GROUP BY 1""")
def proximity_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), seconds().alias("t"), F.floor(F.col("event_id") / 6).alias("o"))
    return G.clustered(e, ["k"], "t", "o", 900)


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS a, greatest(c_custkey - 1, c_custkey - c_custkey % 6) AS b FROM customer), s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(o, r) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT s.b, c.r FROM c JOIN s ON s.a = c.o) SELECT o AS c_custkey, min(r) AS patient FROM c WHERE o IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def patient_components(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    pairs = c.select(k.alias("a"), F.greatest(k - 1, k - k % 6).alias("b"))
    return G.patients(c, pairs, "c_custkey", "a", "b")


@query()
def discordant_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return G.bands(o.select("o_orderkey", "o_orderpriority", days("o_orderdate").alias("p"), F.col("o_totalprice").alias("q")), ["o_orderpriority"], F.col("p"), F.col("q"), 40, "o_orderkey")


SIGNATURES = {"S1": {"A": 0.7, "N": 0.2, "R": 0.1}, "S2": {"A": 0.1, "N": 0.8, "R": 0.1}, "S3": {"A": 0.2, "N": 0.1, "R": 0.7}}


@query()
def nnls_signature(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return M.signature_fit(counts, "l_suppkey", "l_returnflag", "n", SIGNATURES).withColumns({"allocation": F.round("allocation", 3), "percent": F.round("percent", 5)})


@query()
def em_abundance(spark, sf_dir):
    sets = F.array_sort(F.array_distinct(F.array(F.col("l_linenumber") % 4, F.col("l_suppkey") % 4)))
    categories = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("gene"), sets.alias("transcripts")).agg(F.count("*").alias("n"))
    return M.abundance(categories, "gene", "transcripts", "n").withColumn("abundance", F.round("abundance", 4))


#: Five-point Gauss rule over a bin, which a normal kernel ten times as wide as the bin meets to more than ten digits.
_GAUSS = " + ".join(f"{w} * exp(-0.5 * pow((x - v + {t} * 0.0005) / 0.01, 2))" for t, w in ((0.0, 0.5688888888888889), (0.5384693101056831, 0.47862867049936647), (-0.5384693101056831, 0.47862867049936647), (0.906179845938664, 0.23692688505618908), (-0.906179845938664, 0.23692688505618908)))


@query(f"""WITH b AS (SELECT l_returnflag, round(l_discount / 0.001) * 0.001 AS v, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT i / 100.0::DOUBLE AS x FROM unnest(generate_series(0, 51)) AS u(i)), d AS (SELECT l_returnflag, x, sum(n * ({_GAUSS}) / 2 / 0.01 / sqrt(2 * pi())) / sum(n) AS density FROM b, x GROUP BY ALL),
w AS (SELECT *, lag(density) OVER w AS a, lead(density) OVER w AS c FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY x)) SELECT l_returnflag, x, round(density, 6) AS density FROM w WHERE density > coalesce(a, -1) AND density > coalesce(c, -1)""")
def kde_peaks(spark, sf_dir):
    curve = M.density(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", [i / 100 for i in range(52)], 0.01)
    return M.peaks(curve, ["l_returnflag"]).withColumn("density", F.round("density", 6))


@query()
def umi_network(spark, sf_dir):
    u = F.translate(F.substring("o_orderpriority", 3, 4), "EIOUAGHLMNPRDSWTFC", "ACGTACGTACGTACGTAC")
    r = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 200).alias("position"), F.concat(u, (F.col("o_orderkey") % 3).cast("string")).alias("umi")).agg(F.count("*").alias("n"))
    return M.umi_groups(r, ["position"], "umi", "n")


@query()
def roh_like_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", seconds().alias("t"), (F.col("event_type") == "error").alias("het"))
    return M.homozygous_runs(e, ["user_id"], "t", "het", 10, 2, 10, 1000)


@query("""WITH v AS (SELECT l_partkey, l_linenumber, l_suppkey % 4 AS base, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_partkey, l_linenumber, base, q FROM v QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY q DESC, base) = 1""")
def consensus_base(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linenumber", (F.col("l_suppkey") % 4).alias("base")).agg(F.sum("l_quantity").alias("q"))
    best = F.max_by(F.struct("base", "q"), F.struct("q", -F.col("base")))
    return votes.groupBy("l_partkey", "l_linenumber").agg(best.alias("b")).select("l_partkey", "l_linenumber", "b.base", "b.q")

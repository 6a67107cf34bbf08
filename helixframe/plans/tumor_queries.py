"""Copy number, structural variants, reads, HLA and panels over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import purity as P
from ..functions import sequences as Q
from ..operators import copynumber as C
from ..operators import immune as H
from ..operators import reads as R
from ..operators import structural as S
from ..storage import table
from .registry import days, query

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"
#: Disjoint segments of each customer between orders on distinct days, with a copy number and a minor one.
SEGMENTS = f"""d AS (SELECT o_custkey AS chromosome, {DAY.format('o_orderdate')} AS start, max(o_orderkey) AS o, max(round(o_totalprice / 100000, 1)) AS cn FROM orders GROUP BY ALL),
s AS (SELECT chromosome, start, coalesce(lead(start) OVER (PARTITION BY chromosome ORDER BY start) - 1, start + 90) AS "end", cn, (o % 10) / 5.0::DOUBLE AS minor FROM d)"""


def segments(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("chromosome"), days("o_orderdate").alias("start")).agg(F.max("o_orderkey").alias("o"), F.max(F.round(F.col("o_totalprice") / 100000, 1)).alias("cn"))
    order = Window.partitionBy("chromosome").orderBy("start")
    return d.select("chromosome", "start", F.coalesce(F.lead("start").over(order) - 1, F.col("start") + 90).alias("end"), "cn", ((F.col("o") % 10) / 5).alias("minor"))


@query(f"""WITH {SEGMENTS}, e AS (SELECT c_custkey AS chromosome, c_custkey * 10 + k AS gene, 8800 + 400 * k + 150 * j AS a, 8800 + 400 * k + 150 * j + 60 AS b FROM customer, unnest([0, 1, 2, 3]) AS u(k), unnest([0, 1, 2]) AS v(j)),
h AS (SELECT DISTINCT gene, s.* FROM e JOIN s ON e.chromosome = s.chromosome AND a <= s."end" AND s.start <= b),
l AS (SELECT gene, min(cn) AS mn, max(cn) AS mx, min(minor) AS mm, count(*) AS n FROM h GROUP BY 1),
t AS (SELECT h.*, CASE WHEN start - lag("end") OVER (PARTITION BY gene ORDER BY start) > 1 THEN 1 ELSE 0 END AS f FROM h JOIN l USING (gene) WHERE cn = mn),
r AS (SELECT *, sum(f) OVER (PARTITION BY gene ORDER BY start) AS run FROM t)
SELECT gene, mn AS min, mx AS max, mm AS min_minor, n AS regions, ms::BIGINT AS min_start, me::BIGINT AS min_end, k::BIGINT AS min_regions FROM l JOIN (SELECT gene, min(start) AS ms, max("end") FILTER (run = 0) AS me, max(run) + 1 AS k FROM r GROUP BY 1) USING (gene)""")
def gene_copy_number(spark, sf_dir):
    k, j = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("j")
    e = table(spark, sf_dir, "customer").select("c_custkey", k).select("c_custkey", "k", j)
    start = 8800 + 400 * F.col("k") + 150 * F.col("j")
    exons = e.select(F.col("c_custkey").alias("chromosome"), (F.col("c_custkey") * 10 + F.col("k")).alias("gene"), start.cast("long").alias("exon_start"), (start + 60).cast("long").alias("exon_end"))
    return C.gene_copy_number(exons, segments(spark, sf_dir), 128)


@query(f"""WITH {SEGMENTS} SELECT chromosome, CASE WHEN start < 10000 THEN 'P' ELSE 'Q' END AS arm, round(sum(cn * ("end" - start + 1)) / sum("end" - start + 1), 6) AS mean, round(quantile_cont(cn, 0.5), 6) AS median, min(cn) AS min, max(cn) AS max FROM s GROUP BY ALL""")
def arm_copy_number(spark, sf_dir):
    out = C.arm_copy_number(segments(spark, sf_dir), F.when(F.col("start") < 10000, "P").otherwise("Q"))
    return out.withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@query(f"""WITH {SEGMENTS}, l AS (SELECT *, max("end") OVER (PARTITION BY chromosome ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE minor < 0.5),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 21 THEN 1 ELSE 0 END) OVER (PARTITION BY chromosome ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT chromosome, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", count(*) AS n FROM g GROUP BY chromosome, g""")
def loh_events(spark, sf_dir):
    return C.loss_events(segments(spark, sf_dir), ["chromosome"], "start", "end", "minor", 0.5, 20)


@query(f"""WITH {SEGMENTS} SELECT chromosome, round(coalesce(sum("end" - start + 1) FILTER (minor < 0.5), 0) / sum("end" - start + 1)::DOUBLE, 8) AS fraction FROM s GROUP BY 1""")
def loh_fraction(spark, sf_dir):
    return C.loss_fraction(segments(spark, sf_dir), ["chromosome"], "start", "end", "minor").withColumn("fraction", F.round("fraction", 8))


@query(f"""WITH {SEGMENTS}, c AS (SELECT *, chromosome % 23 = 0 AS mx, start % 2 = 0 AS su, chromosome % 5 = 0 AS w FROM s)
SELECT chromosome, start::BIGINT AS start, CASE WHEN cn >= 2.1 * 1.8 * (CASE WHEN mx THEN 0.5 ELSE 1.0 END) THEN 'AMP' WHEN cn < 0.5 AND (NOT w OR su) THEN 'DEL' WHEN NOT mx AND cn >= 0.5 AND cn / 2.1 < 0.6 THEN 'HET_DEL' WHEN NOT mx AND minor < 0.5 THEN 'LOH' END AS driver FROM c""")
def copy_number_drivers(spark, sf_dir):
    k = F.col("chromosome")
    call = C.driver_call(F.col("cn"), F.col("minor"), F.lit(2.1), k % 23 == 0, F.col("start") % 2 == 0, k % 5 == 0, amplified=1.8)
    return segments(spark, sf_dir).select("chromosome", "start", call.alias("driver"))


@query("""WITH v AS (SELECT l_suppkey AS s, l_partkey % 300 AS g, max((l_quantity = 50)::INT) AS h, max((l_linenumber = 7 AND l_discount > 0.07)::INT) AS b, count(*) FILTER (l_tax <> 0) AS n FROM lineitem GROUP BY ALL HAVING count(*) FILTER (l_tax <> 0) > 0),
r AS (SELECT *, (g % 9 + 1) / 20.0::DOUBLE AS d, (g % 13) / 40.0::DOUBLE AS p FROM v), x AS (SELECT *, CASE WHEN n >= 2 THEN (1 - exp(-p)) * (1 - exp(-p)) ELSE 1 - exp(-p) END AS q FROM r)
SELECT s AS sample, g AS gene, CASE WHEN h = 1 THEN 'HOTSPOT' WHEN b = 1 THEN 'BIALLELIC_INFRAME' ELSE 'DNDS' END AS method, round(CASE WHEN h = 1 OR b = 1 THEN 1 ELSE d / (d + q * (1 - d)) END, 8) AS likelihood FROM x""")
def driver_likelihood(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    v = i.select(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 300).alias("gene"), (F.col("l_quantity") == 50).alias("hotspot"), F.lit(False).alias("inframe"), ((F.col("l_linenumber") == 7) & (F.col("l_discount") > 0.07)).alias("biallelic"), (F.col("l_tax") == 0).alias("splice_region"))
    g = spark.range(300).select(F.col("id").alias("gene"), ((F.col("id") % 9 + 1) / 20).alias("drivers"), ((F.col("id") % 13) / 40).alias("passengers"))
    return C.driver_likelihood(v, g).withColumn("likelihood", F.round("likelihood", 8))


@query(f"""WITH {SEGMENTS}, b AS (SELECT o_orderkey AS id, o_custkey AS chromosome, {DAY.format('o_orderdate')} AS position FROM orders)
SELECT id, b.chromosome, b.position::BIGINT AS position, l.cn AS left_cn, r.cn AS right_cn FROM b LEFT JOIN s l ON l.chromosome = b.chromosome AND l."end" + 1 = b.position LEFT JOIN s r ON r.chromosome = b.chromosome AND r.start = b.position""")
def breakend_sides(spark, sf_dir):
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chromosome"), days("o_orderdate").alias("position"))
    return C.sides(b, segments(spark, sf_dir))


@query("""WITH x AS (SELECT c_custkey AS s, round(0.3 + (c_custkey % 90) / 100.0::DOUBLE, 4) AS x, round((c_custkey % 41) / 50.0::DOUBLE, 4) AS y, c_custkey % 7 * 300 AS n, round(0.7 + (c_custkey % 30) / 100.0::DOUBLE, 4) AS a, round(0.8 + (c_custkey % 61) / 100.0::DOUBLE, 4) AS t FROM customer),
g AS (SELECT *, CASE WHEN x >= 0.65 AND (y < 0.05 OR n < 1000) THEN 'FEMALE' ELSE 'MALE' END AS gender FROM x), f AS (SELECT s, gender, concat_ws(';', CASE WHEN gender = 'FEMALE' AND x < least(0.8, a) THEN 'MOSAIC_X' END, CASE WHEN gender = 'MALE' AND x >= 0.65 THEN 'KLINEFELTER' END, CASE WHEN gender = 'MALE' AND y >= 0.75 THEN 'XYY' END, CASE WHEN t >= 1.35 THEN 'TRISOMY_21' END) AS f FROM g)
SELECT s AS sample, gender, CASE WHEN f = '' THEN 'NONE' ELSE f END AS aberrations FROM f""")
def gender_calls(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("sample"), F.round(0.3 + (k % 90) / 100, 4).alias("x"), F.round((k % 41) / 50, 4).alias("y"), (k % 7 * 300).alias("n"), F.round(0.7 + (k % 30) / 100, 4).alias("a"), F.round(0.8 + (k % 61) / 100, 4).alias("t"))
    g = c.withColumn("gender", P.gender(F.col("x"), F.col("y"), F.col("n")))
    return g.select("sample", "gender", P.aberrations(F.col("gender"), F.col("x"), F.col("y"), F.col("a"), {"21": F.col("t")}).alias("aberrations"))


@query("""WITH r AS (SELECT l_orderkey AS s, l_returnflag AS c, (l_quantity * 150000)::BIGINT AS n FROM lineitem),
b AS (SELECT s, sum(n) / 2.88e9 AS p FROM r WHERE n > 3000000 GROUP BY 1), a AS (SELECT s, count(DISTINCT c) AS k, min(c) AS upd, sum(n) AS t FROM r WHERE n >= 3000000 GROUP BY 1)
SELECT s AS sample, round(coalesce(p, 0), 8) AS proportion, CASE WHEN k = 1 AND t >= 10000000 THEN upd END AS upd FROM (SELECT DISTINCT s FROM r) LEFT JOIN b USING (s) LEFT JOIN a USING (s)""")
def consanguinity(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_returnflag").alias("chromosome"), (F.col("l_quantity") * 150000).cast("long").alias("length"))
    return C.consanguinity(r, "sample", "chromosome", "length").withColumn("proportion", F.round("proportion", 8))


@query(f"""WITH {SEGMENTS}, p AS (SELECT DISTINCT o_custkey AS chromosome, {DAY.format('o_orderdate')} + o_orderkey % 40 - 20 AS position FROM orders)
SELECT p.chromosome, p.position::BIGINT AS position, CASE WHEN s.start IS NOT NULL THEN p.chromosome + 1 END AS lifted_chromosome, (CASE WHEN s.start IS NULL THEN NULL WHEN s.start % 2 = 0 THEN 1000 + s.start + s."end" - s.start - (p.position - s.start) ELSE 1000 + p.position END)::BIGINT AS lifted_position FROM p LEFT JOIN s ON s.chromosome = p.chromosome AND p.position BETWEEN s.start AND s."end\"""")
def liftover(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chromosome"), (days("o_orderdate") + F.col("o_orderkey") % 40 - 20).alias("position")).distinct()
    chain = segments(spark, sf_dir).select("chromosome", "start", "end", (F.col("chromosome") + 1).alias("to_chromosome"), (F.col("start") + 1000).alias("to_start"), (F.col("start") % 2 == 0).alias("reverse"))
    return C.lifted(p, chain, 128)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, (l_tax > 0.01) AND row_number() OVER (PARTITION BY l_tax <= 0.01, l_partkey, l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_extendedprice) > 1 AS duplicate FROM lineitem""")
def sv_dedup(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").withColumn("filtered", F.col("l_tax") <= 0.01)
    return S.duplicates(v, ["l_partkey", "l_suppkey"], "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice", "duplicate")


BREAKENDS = f"b AS (SELECT o_custkey AS k, {DAY.format('o_orderdate')} AS p, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END AS o, o_orderkey % 4 AS w FROM orders)"


def breakends(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), days("o_orderdate").alias("p"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(-1).alias("o"), (F.col("o_orderkey") % 4).alias("w"))


@query(f"""WITH {BREAKENDS}, n AS (SELECT *, lead(p) OVER q AS p1, lead(o) OVER q AS o1, lead(w) OVER q AS w1, lead(p, 2) OVER q AS p2, lead(o, 2) OVER q AS o2, lead(w, 2) OVER q AS w2 FROM b WINDOW q AS (PARTITION BY k ORDER BY p, w, o)),
x AS (SELECT k, w AS first, w1 AS second, p1 - p AS distance, CASE WHEN o = 1 AND o1 = -1 AND NOT coalesce(o1 = 1 AND o2 = -1 AND w1 <> w2 AND p2 - p1 < p1 - p, false) THEN 'DB' WHEN o = -1 AND o1 = 1 AND p1 - p < 30 THEN 'DB_OVERLAP' WHEN o = -1 AND o1 = 1 THEN 'TI' END AS kind FROM n WHERE w <> w1)
SELECT k, first, second, kind, distance::BIGINT AS distance FROM x WHERE kind IS NOT NULL""")
def templated_insertions(spark, sf_dir):
    return S.pair_links(breakends(spark, sf_dir), ["k"], "p", "o", "w")


@query(f"WITH {BREAKENDS}, n AS (SELECT *, lead(p) OVER q AS p1, lead(o) OVER q AS o1, lead(w) OVER q AS w1 FROM b WINDOW q AS (PARTITION BY k ORDER BY p, w, o)) SELECT k, w, p::BIGINT AS start, p1::BIGINT AS \"end\" FROM n WHERE w = w1 AND o = o1")
def foldbacks(spark, sf_dir):
    return S.foldbacks(breakends(spark, sf_dir), ["k"], "p", "o", "w")


PAIRS = f"""p AS (SELECT o_orderkey AS id, o_custkey % 50 AS chr1, {DAY.format('o_orderdate')} AS pos1, o_orderpriority AS or1, 1 AS chr2, CAST(floor(o_totalprice / 500) AS BIGINT) AS pos2, 1 AS or2 FROM orders)"""


@query(f"""WITH {PAIRS} SELECT a.id, coalesce(max(b.id % 9), 0)::BIGINT AS samples FROM p a LEFT JOIN p b ON b.id % 4 = 0 AND a.chr1 = b.chr1 AND a.or1 = b.or1 AND abs(a.pos1 - b.pos1) <= 20 AND abs(a.pos2 - b.pos2) <= 20 GROUP BY 1""")
def sv_panel(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("chr1"), days("o_orderdate").alias("pos1"), F.col("o_orderpriority").alias("or1"), F.lit(1).alias("chr2"), F.floor(F.col("o_totalprice") / 500).alias("pos2"), F.lit(1).alias("or2"))
    known = p.filter("id % 4 = 0").withColumn("samples", F.col("id") % 9).drop("id")
    return S.pair_panel(p, known, 20, 64).select("id", "samples")


@query("""WITH a AS (SELECT l_orderkey AS sv, l_linenumber AS gene, l_suppkey % 3 AS phase, l_tax > 0.02 AS coding, l_returnflag = 'A' AS up, l_extendedprice AS e FROM lineitem),
b AS (SELECT x.sv, x.gene AS up_gene, y.gene AS down_gene, x.phase = y.phase AS phased, (x.gene = 1 AND y.gene = 2) AS known, x.e AS xe, y.e AS ye FROM a x JOIN a y ON x.sv = y.sv WHERE x.up AND NOT y.up AND x.gene <> y.gene AND ((x.gene = 1 AND y.gene = 2) OR (x.coding AND y.coding)))
SELECT sv, up_gene, down_gene, phased, known FROM b QUALIFY row_number() OVER (PARTITION BY sv ORDER BY known DESC, phased DESC, xe DESC, ye DESC, up_gene, down_gene) = 1""")
def gene_fusions(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sv"), F.col("l_linenumber").alias("gene"), (F.col("l_suppkey") % 3).alias("phase"), (F.col("l_tax") > 0.02).alias("coding"), (F.col("l_returnflag") == "A").alias("upstream"), F.col("l_extendedprice").alias("e"))
    known = spark.createDataFrame([(1, 2)], "five int, three int")
    found = S.fusions(a, a, known, [F.desc("up_e"), F.desc("down_e"), F.col("up_gene"), F.col("down_gene")])
    return found.select("sv", "up_gene", "down_gene", "phased", "known")


@query("""WITH b AS (SELECT l_orderkey AS sv, l_suppkey % 20 AS t, CASE WHEN l_linenumber < 6 THEN l_linenumber % 3 END AS i FROM lineitem), n AS (SELECT sv, t, count(*) AS n, count(DISTINCT i) AS k, count(*) FILTER (i IS NULL) AS x FROM b GROUP BY ALL)
SELECT t AS transcript, sv FROM n WHERE NOT (n = 2 AND k = 1 AND x = 0)""")
def gene_disruptions(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sv"), (F.col("l_suppkey") % 20).alias("transcript"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber") % 3).alias("intron"))
    return S.disrupted(b)


@query(f"""WITH e AS (SELECT l_returnflag AS chr, {DAY.format('l_shipdate')} AS p, l_linestatus AS o, count(*) AS support FROM lineitem GROUP BY ALL), n AS (SELECT *, sum(support) OVER (PARTITION BY chr, o ORDER BY p RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS nearby FROM e)
SELECT chr, p::BIGINT AS p, o, support, nearby::BIGINT AS nearby FROM n WHERE support >= 5""")
def sv_junctions(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chr"), days("l_shipdate").alias("p"), F.col("l_linestatus").alias("o"))
    return S.junctions(r, ["chr"], "p", "o", 5, 5)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, count(*) OVER (PARTITION BY l_partkey, l_linenumber) AS group_size, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_quantity DESC, l_orderkey) = 1 AS primary_ FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_partkey * 10 + l_linenumber))""")
def duplicate_reads(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    once = i.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct(F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("k")).filter("n = k").select("l_orderkey")
    return R.duplicate_groups(i.join(once, "l_orderkey", "left_semi"), ["l_partkey", "l_linenumber"], "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_extendedprice", "group_size", F.col("primary").alias("primary_"))


@query("""WITH s AS (SELECT p_partkey AS c, p_size % 7 + 1 AS position, p_size % 4 AS ref, (p_size + 1) % 4 AS alt FROM part), r AS (SELECT l_partkey AS c, l_linenumber AS position, l_suppkey % 4 AS base, CAST(l_quantity AS INT) AS quality FROM lineitem)
SELECT s.c, s.position, ref, alt, count(base) AS depth, count(*) FILTER (quality >= 10 AND base = ref) AS ref_support, count(*) FILTER (quality >= 10 AND base = alt) AS alt_support, coalesce(sum(quality) FILTER (quality >= 10 AND base = alt), 0)::BIGINT AS qual FROM s LEFT JOIN r ON s.c = r.c AND s.position = r.position GROUP BY ALL""")
def site_evidence(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c"), (F.col("p_size") % 7 + 1).alias("position"), (F.col("p_size") % 4).alias("ref"), ((F.col("p_size") + 1) % 4).alias("alt"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("c"), F.col("l_linenumber").alias("position"), F.col("l_suppkey"), F.col("l_quantity").cast("int").alias("quality"))
    return R.evidence(r, s, ["c"], "position", F.col("l_suppkey") % 4, 10)


@query("""SELECT coalesce(a.k, b.k) AS k, a.v, b.v AS mate_v FROM (SELECT l_orderkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, max(l_extendedprice) AS v FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b ON a.k = b.k""")
def mate_pairs(spark, sf_dir):
    side = lambda n: table(spark, sf_dir, "lineitem").filter(F.col("l_linenumber") == n).groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("v"))
    return R.mates(side(1), side(2), "k", ["v"])


@query("""SELECT l_linestatus AS unit, l_linenumber AS count, count(*) FILTER (j = -2) AS jm2, count(*) FILTER (j = -1) AS jm1, count(*) FILTER (j = 0) AS j0, count(*) FILTER (j = 1) AS j1, count(*) FILTER (j = 2) AS j2, round(avg(abs(j)), 8) AS error_rate FROM (SELECT *, (l_suppkey % 5 - 2) AS j FROM lineitem) GROUP BY ALL""")
def jitter_table(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("unit"), F.col("l_linenumber").alias("count"), (F.col("l_suppkey") % 5 - 2).alias("j"))
    return R.jitter_table(r, "unit", "count", "j", 2).withColumn("error_rate", F.round("error_rate", 8))


@query()
def local_phase_sets(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.first(F.col("l_orderkey") % 40).alias("region"), F.array_sort(F.collect_set(F.col("l_linenumber") % 5)).alias("v"))
    return R.phase_sets(r, "region", "v", 3)


@query(f"""WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey % 100 AS s, {DAY.format('o_orderdate')} AS a, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
g(s, r, k, kept, starts) AS (SELECT s, r, o_orderkey, true, [a] FROM o WHERE r = 1 UNION ALL SELECT s, r, k, ok, CASE WHEN ok THEN list_append(starts, a) ELSE starts END FROM (SELECT o.s, o.r, o.o_orderkey AS k, o.a, g.starts, NOT list_has_any(g.starts, [o.a - 3, o.a - 2, o.a - 1, o.a, o.a + 1, o.a + 2, o.a + 3]) AS ok FROM g JOIN o ON o.s = g.s AND o.r = g.r + 1))
SELECT k AS o_orderkey, kept FROM g""")
def overlap_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("set"), days("o_orderdate").alias("a"), (days("o_orderdate") + 3).alias("b"), "o_totalprice")
    return R.greedy_dedup(o, "set", "a", "b", "o_totalprice", "o_orderkey").select("o_orderkey", "kept")


@query("""WITH t AS (SELECT s_suppkey % 20 AS gene, s_suppkey AS id, s_suppkey % 17 AS a, s_suppkey % 17 + 20 + s_suppkey % 5 AS b FROM supplier), x AS (SELECT gene, id, n, p FROM t, unnest([10, 15]) AS u(n), unnest(generate_series(a, b - n + 1)) AS v(p)),
m AS (SELECT gene, n, p, string_agg(id::VARCHAR, ';' ORDER BY id) AS members FROM x GROUP BY ALL) SELECT gene, members, n::BIGINT AS length, count(*) AS n FROM m GROUP BY ALL""")
def expected_rates(spark, sf_dir):
    k = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select((k % 20).alias("gene"), k.alias("id"), (k % 17).cast("long").alias("start"), (k % 17 + 20 + k % 5).cast("long").alias("end"))
    return R.expected_rates(t, [10, 15]).withColumn("members", F.array_join("members", ";"))


@query("""WITH w AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_suppkey) AS most FROM (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS name, max(l_extendedprice) AS score, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)), c AS (SELECT * FROM w WHERE l_quantity >= most * 0.75),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, name) AS rank, max(score) OVER (PARTITION BY l_suppkey) AS best, first_value(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY score DESC, name) AS cover FROM c)
SELECT l_suppkey, name, score, rank FROM r WHERE score >= best - 20 * cover OR rank <= 2""")
def complex_ranking(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("name")).agg(F.max("l_extendedprice").alias("score"), F.max("l_quantity").alias("coverage"))
    return H.ranked_complexes(c, "l_suppkey", "score", "coverage", "name", 20.0).select("l_suppkey", "name", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT (l_partkey % 30)::VARCHAR AS gene, list_sort(list_distinct(['A' || l_suppkey % 4, 'A' || l_linenumber % 3])) AS s, count(*) AS n FROM lineitem GROUP BY ALL), a AS (SELECT DISTINCT gene, unnest(s) AS a FROM s), f(a, f) AS (VALUES ('A0', 0.3), ('A1', 0.1)),
p AS (SELECT x.gene, x.a AS first, y.a AS second, sum(CASE WHEN list_contains(s, x.a) OR list_contains(s, y.a) THEN n ELSE 0 END)::BIGINT AS coverage FROM a x JOIN a y ON x.gene = y.gene AND x.a <= y.a JOIN s ON s.gene = x.gene GROUP BY ALL)
SELECT gene, first, second, coverage, round(coverage + (log10(coalesce(g.f, 0.0001)) + log10(coalesce(h.f, 0.0001))) * 0.018 * coverage, 6) AS score FROM p LEFT JOIN f g ON g.a = first LEFT JOIN f h ON h.a = second""")
def hla_complexes(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    f = i.select((F.col("l_partkey") % 30).cast("string").alias("gene"), F.array(F.concat(F.lit("A"), (F.col("l_suppkey") % 4).cast("string")), F.concat(F.lit("A"), (F.col("l_linenumber") % 3).cast("string"))).alias("alleles"))
    return H.complex_scores(f, {"A0": 0.3, "A1": 0.1}).withColumn("score", F.round("score", 6))


HAPLOTYPES = {"A": {"*1": {}, "*2": {"e1": 1}, "*3": {"e2": 1}, "*4": {"e1": 1, "e2": 1}}}


@query()
def pgx_haplotypes(spark, sf_dir):
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(k.alias("sample"), F.lit("A").alias("gene"), F.explode(F.array(F.struct(F.lit("e1").alias("event"), (k % 3).alias("count")), F.struct(F.lit("e2").alias("event"), F.when(k % 11 != 0, k % 2).alias("count")))).alias("e"))
    return H.called_haplotypes(e.select("sample", "gene", "e.event", "e.count"), HAPLOTYPES, {"A": "*1"})


@query()
def receptor_collapse(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    w = d.select("lang", F.explode(F.filter(F.split("text", " "), lambda x: x != "")).alias("s"))
    return H.collapsed_sequences(w, "lang", "s")


@query("""WITH p AS (SELECT item_id, upper(regexp_replace(text, '[^a-z]', '', 'g')) AS s FROM benchmark) SELECT item_id, (i)::INT AS position, substring(s, i, k) AS peptide FROM p, unnest([8, 9]) AS u(k), unnest(generate_series(1, length(s) - k + 1)) AS v(i) WHERE length(s) >= k""")
def neo_peptides(spark, sf_dir):
    p = table(spark, sf_dir, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^a-z]", "")).alias("s"))
    return H.peptides(p, "item_id", "s", [8, 9])


@query("""WITH c AS (SELECT l_suppkey % 5 AS allele, o_orderpriority AS pep, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), e AS (SELECT allele, length(pep) AS length, i - 1 AS position, substring(pep, i, 1) AS residue, sum(n) AS n FROM c, unnest(generate_series(1, length(pep))) AS u(i) GROUP BY ALL)
SELECT allele, length::INT AS length, position::INT AS position, residue, round(log2((n + 1) / (sum(n) OVER (PARTITION BY allele, length, position) + 20)::DOUBLE * 20), 6) AS weight FROM e""")
def position_weights(spark, sf_dir):
    i, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("l_suppkey") % 5).alias("allele"), F.col("o_orderpriority").alias("pep")).agg(F.count("*").alias("n"))
    return H.position_weights(c, "allele", "pep", "n").withColumn("weight", F.round("weight", 6))


@query("""WITH r AS (SELECT o_orderkey, 1000 + o_custkey AS a, 1000 + o_custkey + o_orderkey % 400 AS b FROM orders), t AS (SELECT DISTINCT o_orderkey, least(a + i * 60, b - 119) AS s FROM r, unnest(generate_series(0, CAST(greatest(0, ceil((b - a + 1 - 120) / 60.0)) AS BIGINT))) AS u(i) WHERE b - a + 1 > 120
 UNION ALL SELECT o_orderkey, CAST(floor((a + b + 1 - 120) / 2.0) AS BIGINT) FROM r WHERE b - a + 1 <= 120) SELECT o_orderkey, s::BIGINT AS probe_start, (s + 119)::BIGINT AS probe_end FROM t""")
def probe_tiles(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select("o_orderkey", (1000 + F.col("o_custkey")).cast("long").alias("a"), (1000 + F.col("o_custkey") + F.col("o_orderkey") % 400).cast("long").alias("b"))
    return H.probes(r, "o_orderkey", "a", "b", 120, 60)


@query("""SELECT user_id, greatest(0, 2 * count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'error'))::BIGINT AS reads, round(greatest(0, 2 * count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'error')) * 0.9 * 150 / 30.0 / 0.95 / 46, 6) AS length FROM events GROUP BY 1""")
def telomere_length(spark, sf_dir):
    n = lambda t: F.count_if(F.col("event_type") == t)
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(P.telomere_reads(n("click"), n("view"), n("error")).alias("reads"))
    return e.select("user_id", "reads", F.round(P.telomere_length(F.col("reads"), F.lit(0.1), F.lit(150), F.lit(30.0), F.lit(0.95)), 6).alias("length"))


@query("""SELECT l_suppkey, round(sum(l_quantity) / sum(l_extendedprice / 1000), 8) AS af, round(least(1.0, 2 * avg(l_discount) / (1 + 2 * avg(l_discount) - 2 * avg(l_discount))), 8) AS fraction FROM lineitem GROUP BY 1""")
def tumor_fraction(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg((F.sum("l_quantity") / F.sum(F.col("l_extendedprice") / 1000)).alias("af"), F.avg("l_discount").alias("f"))
    return s.select("l_suppkey", F.round("af", 8).alias("af"), F.round(P.tumor_fraction(F.col("f"), F.lit(1.0), F.lit(2.0)), 8).alias("fraction"))


@query("""SELECT l_suppkey, count(*) FILTER (l_quantity >= 10) AS eligible, count(*) FILTER (l_quantity >= 10 AND l_discount >= 0.05) AS supported, round(count(*) FILTER (l_quantity >= 10 AND l_discount >= 0.05) / count(*) FILTER (l_quantity >= 10)::DOUBLE, 8) AS ratio FROM lineitem GROUP BY 1""")
def rna_genotype_check(spark, sf_dir):
    ok = F.col("l_quantity") >= 10
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(ok).alias("eligible"), F.count_if(ok & (F.col("l_discount") >= 0.05)).alias("supported"))
    return s.withColumn("ratio", F.round(F.col("supported") / F.col("eligible"), 8))


@query("""WITH w AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^acgt]', '', 'g')) AS s FROM documents) SELECT doc_id, (CASE WHEN length(s) >= 40 THEN coalesce(len(list_filter([1, 2, 3, 4, 5, 6], lambda k: substring(s, 1, k) = substring(s, 21, k))), 0) ELSE 0 END)::INT AS homology FROM w""")
def microhomology(spark, sf_dir):
    s = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^acgt]", ""))
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return d.select("doc_id", F.when(F.length("s") >= 40, Q.homology(F.col("s"), F.substring("s", F.lit(21), F.length("s")), 6)).otherwise(0).alias("homology"))

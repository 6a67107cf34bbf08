"""Structural variants: an item or an order stands for a variant, customers for chromosomes, dates for positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sv as S
from ..storage import table
from .registry import days, query

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"
KINDS = ["DEL", "DUP", "INS", "INV", "BND", "SGL"]


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def listed(tests: dict[str, str]) -> str:
    """SQL of the names whose tests hold, joined by ``;``."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items()) + "], lambda x: x IS NOT NULL), ';')"


def _reach(limit: str) -> str:
    return f"((a1 >= {limit} AND (b1 IS NULL OR b1 >= {limit})) OR (a2 >= {limit} AND (b2 IS NULL OR b2 >= {limit})))"


_KIND = "CASE WHEN hotspot THEN {} WHEN type = 'SGL' AND NOT line THEN {} ELSE {} END"
SV_TESTS = {
    "minAF": f"NOT known AND NOT {_reach('(' + _KIND.format(0.001, 0.05, 0.001) + ')')}",
    "minSupport": f"NOT known AND greatest(vf1, vf2) < {_KIND.format(2, 6, 4)}",
    "minQual": "NOT known AND qual < 30",
    "minLength": "type IN ('DEL', 'DUP', 'INS') AND length < 32",
    "minAnchorLength": "NOT known AND NOT line AND NOT (anchor_start >= 50 AND (type = 'SGL' OR anchor_end >= 50))",
    "shortFrags": "NOT known AND type <> 'SGL' AND NOT line AND fragment <> 0 AND fragment < 350 - greatest(3 * 80 / sqrt(greatest(vf1, vf2)), 0.6 * 80)",
    "invShortLowVafHom": f"NOT known AND type = 'INV' AND length <= 3000 AND homology >= 3 AND NOT {_reach('(CASE WHEN homology >= 6 THEN least(0.2, 400 * 0.0002) ELSE least(0.1, 200 * 0.0002) END)')}",
    "invShortFragLowVaf": f"NOT known AND type = 'INV' AND length <= 300 AND NOT {_reach('least(0.05, 50 * 0.0005)')}",
    "delShortLowVaf": f"NOT known AND type = 'DEL' AND length <= 3000 AND homology >= 10 AND fragment + length < 1.5 * 700 AND NOT {_reach('0.05')}",
    "sbArtefact": "(sb = 1 AND (contains(ins, 'GCCGTATCATTAAAAA') OR contains(ins, 'GTAGATCTCGGTGGTC'))) OR (sb = 0 AND (contains(ins, 'TTTTTAATGATACGGC') OR contains(ins, 'GACCACCGAGATCTAC')))",
}


@query(f"""WITH w AS (SELECT *, ['DEL', 'DUP', 'INS', 'INV', 'BND', 'SGL'][1 + l_partkey % 6] AS type FROM lineitem),
v AS (SELECT l_orderkey, l_linenumber, type, l_partkey % 17 = 0 AS hotspot, l_suppkey % 7 = 0 AS line, l_orderkey % 23 = 0 AS known, l_quantity * 2 AS qual, l_linenumber AS vf1, l_suppkey % 9 AS vf2, l_discount / 2 AS a1,
CASE WHEN type <> 'SGL' THEN l_tax / 2 END AS b1, l_discount AS a2, CASE WHEN type <> 'SGL' THEN l_tax END AS b2, l_partkey * 7 % 4000 AS length, l_suppkey % 13 AS homology, 30 + l_partkey % 60 AS anchor_start, 30 + l_suppkey % 60 AS anchor_end,
l_orderkey % 600 AS fragment, l_linenumber % 3 AS sb, CASE l_partkey % 5 WHEN 0 THEN 'AAGCCGTATCATTAAAAACC' WHEN 1 THEN 'GACCACCGAGATCTAC' ELSE 'ACGT' END AS ins FROM w)
SELECT l_orderkey, l_linenumber, CASE WHEN f = '' THEN 'PASS' ELSE f END AS filters FROM (SELECT *, {listed(SV_TESTS)} AS f FROM v)""")
def sv_filters(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "lineitem").withColumn("type", pick(KINDS, c("l_partkey") % 6))
    end = lambda x: F.when(c("type") != "SGL", x)
    sample = lambda vf, a, b: F.struct(vf.cast("long").alias("vf"), a.alias("af_start"), end(b).alias("af_end"))
    insert = F.when(c("l_partkey") % 5 == 0, "AAGCCGTATCATTAAAAACC").when(c("l_partkey") % 5 == 1, "GACCACCGAGATCTAC").otherwise("ACGT")
    v = v.select(
        "l_orderkey", "l_linenumber", "type", (c("l_partkey") % 17 == 0).alias("hotspot"), (c("l_suppkey") % 7 == 0).alias("line"), (c("l_orderkey") % 23 == 0).alias("known"), (c("l_quantity") * 2).alias("qual"),
        F.array(sample(c("l_linenumber"), c("l_discount") / 2, c("l_tax") / 2), sample(c("l_suppkey") % 9, c("l_discount"), c("l_tax"))).alias("genotypes"), (c("l_partkey") * 7 % 4000).alias("length"), (c("l_suppkey") % 13).alias("homology"),
        (30 + c("l_partkey") % 60).alias("anchor_start"), (30 + c("l_suppkey") % 60).alias("anchor_end"), (c("l_orderkey") % 600).alias("fragment_length"), (c("l_linenumber") % 3).alias("strand_bias"), insert.alias("insert_sequence"), F.array().cast("array<string>").alias("existing"),
    )
    return S.filters(v, 350, 80, 700, 0.0002, 0.0005).select("l_orderkey", "l_linenumber", "filters")


#: Breakends of orders: the second one, some positions on, of another chromosome for translocations; singles and inferred ones have none.
ENDS = f"""o AS (SELECT o_orderkey AS sv, o_custkey AS c, {DAY.format('o_orderdate')} * 40 + o_orderkey % 40 AS p, ['INV', 'BND', 'SGL', 'INF', 'DEL'][1 + o_orderkey % 5] AS type, o_totalprice / 4000000 AS f, 1.0 + o_orderkey % 3 AS jcn, 0.5 AS spread, o_orderkey % 100 AS qual,
CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS s FROM orders),
e AS (SELECT sv, c, p AS position, s AS orientation, type, f, jcn, spread, qual FROM o UNION ALL SELECT sv, CASE WHEN type = 'BND' THEN c + 1 ELSE c END, p + sv % 300, CASE WHEN type = 'INV' THEN s ELSE -s END, type, f, jcn, spread, qual FROM o WHERE type NOT IN ('SGL', 'INF'))"""


def ends(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("sv"), F.col("o_custkey").alias("c"), (days("o_orderdate") * 40 + k % 40).alias("p"), pick(["INV", "BND", "SGL", "INF", "DEL"], k % 5).alias("type"), (F.col("o_totalprice") / 4000000).alias("frequency"), (1.0 + k % 3).alias("jcn"), F.lit(0.5).alias("jcn_spread"), (k % 100).alias("qual"), F.when(k % 2 == 0, 1).otherwise(-1).alias("s"))
    rest = ["type", "frequency", "jcn", "jcn_spread", "qual"]
    one = o.select("sv", "c", F.col("p").alias("position"), F.col("s").alias("orientation"), *rest)
    two = o.filter("type NOT IN ('SGL', 'INF')").select("sv", F.when(F.col("type") == "BND", F.col("c") + 1).otherwise(F.col("c")).alias("c"), (F.col("p") + F.col("sv") % 300).alias("position"), F.when(F.col("type") == "INV", F.col("s")).otherwise(-F.col("s")).alias("orientation"), *rest)
    return one.unionByName(two)


@query(f"""WITH {ENDS}, n AS (SELECT a.*, least(a.position - (SELECT max(b.position) FROM e b WHERE b.c = a.c AND b.sv <> a.sv AND (b.position, b.sv) < (a.position, a.sv)), (SELECT min(b.position) FROM e b WHERE b.c = a.c AND b.sv <> a.sv AND (b.position, b.sv) > (a.position, a.sv)) - a.position) AS nearest FROM e a),
w AS (SELECT *, lead(sv) OVER x AS sv2, lead(position) OVER x AS p2, lead(orientation) OVER x AS o2, lead(type) OVER x AS t2, lead(jcn) OVER x AS j2, lead(spread) OVER x AS s2 FROM e WINDOW x AS (PARTITION BY c ORDER BY position, sv, orientation)),
r AS (SELECT sv, 0 AS r FROM n WHERE type IN ('BND', 'SGL') AND f < 0.05 GROUP BY sv HAVING min(coalesce(nearest, 5001)) > 5000
UNION ALL SELECT sv, 0 FROM w WHERE type = 'INV' AND sv2 = sv AND p2 - position <= 100 AND f < 0.05
UNION ALL SELECT unnest([sv, sv2]), 1 FROM w WHERE type = 'INF' AND t2 = 'INF' AND orientation <> o2 AND abs(jcn - j2) <= greatest(spread, s2)
UNION ALL SELECT CASE WHEN type = 'SGL' THEN sv ELSE sv2 END, 2 FROM w WHERE sv2 <> sv AND orientation = o2 AND p2 - position <= 1 AND (type = 'SGL' OR t2 = 'SGL'))
SELECT sv, ['LOW_VAF', 'PAIR_INF', 'DUP_BE'][1 + min(r)] AS reason FROM r GROUP BY 1""")
def sv_artefacts(spark, sf_dir):
    return S.artefacts(ends(spark, sf_dir), ["c"])


@query(f"""WITH a AS (SELECT o_orderkey AS id, o_custkey AS c, {DAY.format('o_orderdate')} AS s, {DAY.format('o_orderdate')} + 60 + o_orderkey % 200 AS e, 100 + o_orderkey % 900 AS n FROM orders), m AS (SELECT o_custkey AS c, {DAY.format('o_orderdate')} + 30 AS x, {DAY.format('o_orderdate')} + 30 + o_orderkey % 120 AS y, o_orderpriority AS r FROM orders),
h AS (SELECT id, r, (least(e, y) - greatest(s, x) + 1) AS k, n FROM a JOIN m ON a.c = m.c AND s <= y AND x <= e), g AS (SELECT id, r, k / n::DOUBLE AS v FROM h WHERE k >= 20 AND k / n::DOUBLE > 0.1)
SELECT id, r AS repeat, round(v, 8) AS coverage FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, r) = 1""")
def repeat_masks(spark, sf_dir):
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), days("o_orderdate")
    a = o.select(k.alias("id"), F.col("o_custkey").alias("chromosome"), d.alias("start"), (d + 60 + k % 200).alias("end"), (100 + k % 900).alias("insert_length"))
    m = o.select(F.col("o_custkey").alias("chromosome"), (d + 30).alias("start"), (d + 30 + k % 120).alias("end"), F.col("o_orderpriority").alias("repeat"))
    return S.repeat_masked(a, m, 128).withColumn("coverage", F.round("coverage", 8))


@query(f"""WITH RECURSIVE v AS (SELECT o_custkey AS k, {DAY.format('o_orderdate')} AS a, {DAY.format('o_orderdate')} + 20 + o_orderkey % 90 AS b, o_orderkey // 8 AS c FROM orders WHERE o_orderkey % 3 = 0),
l AS (SELECT DISTINCT x.c AS a, y.c AS b FROM v x JOIN v y ON x.k = y.k AND x.a <= y.b AND y.a <= x.b AND x.c <> y.c AND ((x.a < y.a AND x.b < y.b) OR (y.a < x.a AND y.b < x.b))),
r(o, t) AS (SELECT DISTINCT c, c FROM v UNION SELECT l.b, r.t FROM r JOIN l ON l.a = r.o) SELECT o AS c, min(t) AS merged FROM r GROUP BY 1""")
def long_overlaps(spark, sf_dir):
    k, d = F.col("o_orderkey"), days("o_orderdate")
    v = table(spark, sf_dir, "orders").filter(k % 3 == 0).select(F.col("o_custkey").alias("k"), d.alias("a"), (d + 20 + k % 90).alias("b"), F.floor(k / 8).alias("c"))
    return S.overlapping_clusters(v, ["k"], "a", "b", "c", 128)


_RESOLVED = """CASE WHEN line THEN 'LINE' WHEN closed THEN 'DOUBLE_MINUTE' WHEN n = 1 AND deletions = 1 THEN 'DEL' WHEN n = 1 AND duplications = 1 THEN 'DUP' WHEN n = 1 AND insertions = 1 THEN 'INS' WHEN n = 1 AND inversions = 1 THEN 'INV' WHEN n = 1 AND translocations = 1 THEN 'UNBAL_TRANS'
WHEN n = 1 AND singles = 1 THEN 'SGL' WHEN n = 1 AND inferred = 1 THEN 'INF' WHEN n = 2 AND translocations = 2 AND facing = 0 THEN 'RECIP_TRANS' WHEN n = 2 AND translocations = 2 THEN 'UNBAL_TRANS_TI' WHEN n = 2 AND inversions = 2 AND foldbacks = 2 THEN 'FB_INV_PAIR' WHEN n = 2 AND inversions = 2 THEN 'RECIP_INV'
WHEN n = 2 AND singles = 2 THEN 'SGL_PAIR_DEL' WHEN n = 2 AND deletions >= 1 AND facing >= 1 THEN 'DEL_TI' WHEN n = 2 AND duplications >= 1 AND facing >= 1 THEN 'DUP_TI' WHEN n = 2 THEN 'PAIR_OTHER' WHEN deletions + duplications + insertions = n THEN 'SIMPLE_GRP' ELSE 'COMPLEX' END"""


@query(f"""WITH g AS (SELECT l_orderkey AS cluster, count(*) AS n, count(*) FILTER (l_partkey % 7 = 0) AS deletions, count(*) FILTER (l_partkey % 7 = 1) AS duplications, count(*) FILTER (l_partkey % 7 = 2) AS insertions, count(*) FILTER (l_partkey % 7 = 3) AS inversions, count(*) FILTER (l_partkey % 7 = 4) AS translocations,
count(*) FILTER (l_partkey % 7 = 5) AS singles, count(*) FILTER (l_partkey % 7 = 6) AS inferred, bool_or(l_suppkey % 29 = 0) AS line, count(*) FILTER (l_partkey % 7 = 3 AND l_linenumber % 2 = 1) AS foldbacks, count(*) FILTER (l_suppkey % 3 = 0) AS facing, bool_or(l_quantity = 50 AND l_suppkey % 2 = 0) AS closed FROM lineitem GROUP BY 1),
r AS (SELECT cluster, {_RESOLVED} AS resolved FROM g)
SELECT cluster, resolved, CASE WHEN resolved = 'LINE' THEN 'INSERTION' WHEN resolved IN ('DEL', 'DUP', 'INS', 'UNBAL_TRANS') THEN 'SIMPLE' WHEN resolved IN ('RECIP_TRANS', 'RECIP_INV') THEN 'RECIPROCAL' WHEN resolved IN ('DUP_TI', 'DEL_TI', 'UNBAL_TRANS_TI') THEN 'TEMPLATED_INSERTION' WHEN resolved = 'DOUBLE_MINUTE' THEN 'DOUBLE_MINUTE'
WHEN resolved IN ('INV', 'SGL', 'INF', 'PAIR_OTHER') THEN 'INCOMPLETE' ELSE 'COMPLEX' END AS category FROM r""")
def cluster_types(spark, sf_dir):
    kind = lambda i: F.count_if(F.col("l_partkey") % 7 == i)
    names = ["deletions", "duplications", "insertions", "inversions", "translocations", "singles", "inferred"]
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cluster")).agg(
        F.count("*").alias("n"), *[kind(i).alias(x) for i, x in enumerate(names)], F.bool_or(F.col("l_suppkey") % 29 == 0).alias("line"), F.count_if((F.col("l_partkey") % 7 == 3) & (F.col("l_linenumber") % 2 == 1)).alias("foldbacks"),
        F.count_if(F.col("l_suppkey") % 3 == 0).alias("facing"), F.bool_or((F.col("l_quantity") == 50) & (F.col("l_suppkey") % 2 == 0)).alias("closed"),
    )
    return g.select("cluster", S.resolved(g).alias("resolved")).withColumn("category", S.category(F.col("resolved")))


@query(f"""WITH b AS (SELECT o_orderkey AS id, o_custkey AS c, {DAY.format('o_orderdate')} AS p FROM orders), r AS (SELECT o_custkey AS c, {DAY.format('o_orderdate')} + 5 AS s, {DAY.format('o_orderdate')} + 5 + o_orderkey % 200 AS e, ['LINE', 'FRAGILE', 'PSEUDOGENE'][1 + o_orderkey % 3] AS kind FROM orders WHERE o_orderkey % 4 = 0)
SELECT id, coalesce((SELECT string_agg(kind, ';' ORDER BY kind) FROM (SELECT DISTINCT kind FROM r WHERE r.c = b.c AND b.p BETWEEN s - 3 AND e + 3)), '') AS flags FROM b""")
def sv_annotations(spark, sf_dir):
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), days("o_orderdate")
    b = o.select(k.alias("id"), F.col("o_custkey").alias("chromosome"), d.alias("position"))
    r = o.filter(k % 4 == 0).select(F.col("o_custkey").alias("chromosome"), (d + 5).alias("start"), (d + 5 + k % 200).alias("end"), pick(["LINE", "FRAGILE", "PSEUDOGENE"], k % 3).alias("kind"))
    return S.flagged(b, r, 128, slack=3)


@query(f"""WITH b AS (SELECT o_orderkey AS id, o_custkey AS c, {DAY.format('o_orderdate')} AS p, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS s, o_orderkey % 5 <> 0 AS line, CASE WHEN o_totalprice > 150000 THEN 'PASS' ELSE 'minQual' END AS f FROM orders)
SELECT id, f AS filters, line AND f <> 'PASS' AND EXISTS (SELECT 1 FROM b g WHERE g.c = b.c AND g.line AND g.f = 'PASS' AND abs(g.p - b.p) <= 100 AND g.s <> b.s) AS rescued FROM b""")
def line_site_pairs(spark, sf_dir):
    k = F.col("o_orderkey")
    b = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("c"), days("o_orderdate").alias("position"), F.when(k % 2 == 0, 1).otherwise(-1).alias("orientation"), (k % 5 != 0).alias("line"), F.when(F.col("o_totalprice") > 150000, "PASS").otherwise("minQual").alias("filters"))
    return S.line_pairs(b, ["c"], 100).select("id", "filters", "rescued")


@query(f"""WITH b AS (SELECT o_orderkey AS id, o_custkey AS c, {DAY.format('o_orderdate')} AS p, o_orderkey % 9 AS vf, o_orderkey % 3 = 0 AS short FROM orders), r AS (SELECT o_custkey AS c, o_orderkey // 2 AS f, {DAY.format('o_orderdate')} - 15 AS s, {DAY.format('o_orderdate')} + 15 AS e, {DAY.format('o_orderdate')} - 150 AS x, {DAY.format('o_orderdate')} + 150 AS y FROM orders),
h AS (SELECT id, f, max(CASE WHEN s <= p - 1 AND e >= p + 1 THEN 1 ELSE 0 END) AS spans FROM b JOIN r ON b.c = r.c AND p BETWEEN x AND y GROUP BY ALL), n AS (SELECT id, sum(spans) AS rr, count(*) - sum(spans) AS rp FROM h GROUP BY 1)
SELECT id, coalesce(rr, 0)::BIGINT AS ref_reads, coalesce(rp, 0)::BIGINT AS ref_pairs, round(CASE WHEN vf + coalesce(rr, 0) + CASE WHEN short THEN 0 ELSE coalesce(rp, 0) END > 0 THEN vf / (vf + coalesce(rr, 0) + CASE WHEN short THEN 0 ELSE coalesce(rp, 0) END)::DOUBLE ELSE 0 END, 8) AS frequency FROM b LEFT JOIN n USING (id)""")
def sv_depth(spark, sf_dir):
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), days("o_orderdate")
    b = o.select(k.alias("id"), F.col("o_custkey").alias("chromosome"), d.alias("position"), (k % 9).alias("variant_fragments"), (k % 3 == 0).alias("short"))
    r = o.select(F.col("o_custkey").alias("chromosome"), F.floor(k / 2).alias("fragment"), (d - 15).alias("start"), (d + 15).alias("end"), (d - 150).alias("insert_start"), (d + 150).alias("insert_end"))
    return S.reference_support(b, r, 128).select("id", "ref_reads", "ref_pairs", F.round("frequency", 8).alias("frequency"))


@query("""WITH b AS (SELECT l_partkey AS gene, CASE WHEN l_linenumber % 2 = 0 THEN 'DUP' ELSE 'BND' END AS type, CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END AS s, l_linenumber % 3 = 0 AS bridged, l_discount * 10 AS u, l_tax * 10 AS v, l_quantity > 25 AS exonic FROM lineitem)
SELECT DISTINCT gene, CASE WHEN s = 1 AND bridged AND u < 0.5 AND v < 0.5 THEN 'HOM_DEL_DISRUPTION' ELSE 'HOM_DUP_DISRUPTION' END AS kind FROM b WHERE (s = 1 AND bridged AND u < 0.5 AND v < 0.5) OR (s = -1 AND type = 'DUP' AND exonic AND u < 0.5)""")
def homozygous_disruption(spark, sf_dir):
    c = F.col
    b = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("gene"), F.when(c("l_linenumber") % 2 == 0, "DUP").otherwise("BND").alias("type"), F.when(c("l_suppkey") % 2 == 0, 1).otherwise(-1).alias("orientation"), (c("l_linenumber") % 3 == 0).alias("bridged"), (c("l_discount") * 10).alias("undisrupted"), (c("l_tax") * 10).alias("span_undisrupted"), (c("l_quantity") > 25).alias("exonic"))
    return S.homozygous_disruptions(b)


@query("""SELECT l_orderkey, l_linenumber, l_partkey % 3 = 0 AND l_returnflag <> 'R' AND (l_suppkey % 40) / 1000.0::DOUBLE <= 0.01 AND NOT (l_linenumber % 3 < 2 AND l_extendedprice * 100 > 5000000) AS reported FROM lineitem""")
def germline_sv_disruptions(spark, sf_dir):
    c = F.col
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey").alias("gene"), pick(["DEL", "DUP", "BND"], c("l_linenumber") % 3).alias("type"), (c("l_extendedprice") * 100).alias("length"), F.when(c("l_returnflag") != "R", "PASS").otherwise("minQual").alias("filters"), ((c("l_suppkey") % 40) / 1000).alias("f"))
    panel = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(c("p_partkey").alias("gene"))
    return S.germline_disruptions(d, panel, c("f")).select("l_orderkey", "l_linenumber", F.coalesce("reported", F.lit(False)).alias("reported"))


@query(f"""WITH s AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 2 AS s, {DAY.format('o_orderdate')} AS p, o_orderkey % 7 AS germline, 40 + o_orderkey % 300 AS tumor, 10 + o_orderkey % 30 AS tel, 40 + o_orderkey % 40 AS anchor, o_orderkey % 11 AS split, o_orderkey % 4 AS pairs, 250 + o_orderkey % 200 AS mapq FROM orders),
f AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY c, s ORDER BY p) > 50 THEN 1 ELSE 0 END AS f FROM s), g AS (SELECT *, sum(f) OVER (PARTITION BY c, s ORDER BY p) AS g FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY c, s, g ORDER BY split DESC, p, id) AS n FROM g),
t AS (SELECT id, {listed({'maxGermlineSupport': 'germline >= least(5, 0.02 * tumor)', 'minTelomericLength': 'tel < 20', 'minAnchorLength': 'anchor < 50', 'minSplitReads': 'split < 3', 'minDiscordantPairs': 'pairs <= 0', 'minTumorMAPQ': 'mapq < 300', 'duplicate': 'n > 1'})} AS f FROM n) SELECT id, CASE WHEN f = '' THEN 'PASS' ELSE f END AS filters FROM t""")
def telomere_breakends(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("c"), (k % 2).alias("s"), days("o_orderdate").alias("p"), (k % 7).alias("germline"), (40 + k % 300).alias("tumor"), (10 + k % 30).alias("telomeric"), (40 + k % 40).alias("anchor"), (k % 11).alias("split"), (k % 4).alias("pairs"), (250 + k % 200).alias("mapq"))
    return S.telomeric_breakends(s, ["c", "s"], "p", 50, "id").select("id", "filters")


@query(f"""WITH v AS (SELECT o_orderkey AS id, o_custkey AS patient, o_orderkey % 4 AS sample, o_orderpriority AS c1, {DAY.format('o_orderdate')} AS p1, o_orderkey % 2 AS s1, o_orderstatus AS c2, {DAY.format('o_orderdate')} + o_orderkey % 60 AS p2, o_orderkey % 3 AS s2 FROM orders)
SELECT a.id, count(DISTINCT b.sample) AS samples FROM v a JOIN v b ON a.patient = b.patient AND a.c1 = b.c1 AND a.s1 = b.s1 AND a.c2 = b.c2 AND a.s2 = b.s2 AND abs(a.p1 - b.p1) <= 100 AND abs(a.p2 - b.p2) <= 100 GROUP BY 1""")
def shared_biopsy_variants(spark, sf_dir):
    k, d = F.col("o_orderkey"), days("o_orderdate")
    v = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("patient"), (k % 4).alias("sample"), F.col("o_orderpriority").alias("chr1"), d.alias("pos1"), (k % 2).alias("or1"), F.col("o_orderstatus").alias("chr2"), (d + k % 60).alias("pos2"), (k % 3).alias("or2"))
    return S.shared_variants(v, 100, 128)


@query("""SELECT l_suppkey AS sample, CASE WHEN l_partkey % 4 = 3 THEN 'TRA' ELSE ['DEL', 'DUP', 'INV'][1 + l_partkey % 4] || CASE WHEN n < 1000 THEN '_0e00_1e03' WHEN n < 10000 THEN '_1e03_1e04' WHEN n < 100000 THEN '_1e04_1e05' WHEN n < 1000000 THEN '_1e05_1e06' WHEN n < 10000000 THEN '_1e06_1e07' ELSE '_1e07_Inf' END END AS context, count(*) AS n
FROM (SELECT *, CAST(floor(l_quantity * l_quantity * l_quantity * l_extendedprice / 1000) AS BIGINT) AS n FROM lineitem) GROUP BY ALL""")
def sv_contexts(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), pick(["DEL", "DUP", "INV", "TRA"], F.col("l_partkey") % 4).alias("type"), F.floor(F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") * F.col("l_extendedprice") / 1000).alias("length"))
    return S.length_bins(v, "sample", "type", "length")

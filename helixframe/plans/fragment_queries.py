"""Fragments and reads: items stand for reads, orders for duplicate groups or regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as N
from ..operators import fragments as X
from ..storage import table
from .registry import days, query
from .sequence_queries import SEQ, sequences
from .sv_queries import pick

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS c, {DAY.format('o_orderdate')} AS s, {DAY.format('o_orderdate')} + 30 AS e, o_orderkey % 30 AS clip, o_orderkey % 7 = 0 AS disc, o_orderkey % 1300 AS frag, o_orderkey % 5 = 0 AS sec FROM orders), g AS (SELECT c_custkey AS c, 8800 + 300 * i AS a, 8800 + 300 * i + 120 AS b, (c_custkey % 4) * 400 AS d FROM customer, unnest(generate_series(0, 6)) AS u(i)),
h AS (SELECT id, sum(least(e, b) - greatest(s, a) + 1) AS inside, max(d) AS d FROM r JOIN g ON r.c = g.c AND s <= b AND a <= e GROUP BY 1)
SELECT id, CASE WHEN 31 - inside < 10 AND sec THEN 'DELETE' WHEN 31 - inside < 10 AND (d > 1000 OR disc OR frag > 1000 OR clip >= 20) THEN 'UNMAP' END AS action FROM r LEFT JOIN h USING (id)""")
def read_unmapping(spark, sf_dir):
    k, d = F.col("o_orderkey"), days("o_orderdate")
    r = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("chromosome"), d.alias("start"), (d + 30).alias("end"), (k % 30).alias("clip"), (k % 7 == 0).alias("discordant"), (k % 1300).alias("fragment"), (k % 5 == 0).alias("secondary"))
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chromosome"), ((F.col("c_custkey") % 4) * 400).alias("depth"), F.explode(F.array(*[F.lit(8800 + 300 * i).cast("long") for i in range(7)])).alias("start"))
    return X.unmapped(r, g.withColumn("end", F.col("start") + 120), 128).select("id", "action")


_UMI = "['ACGTA', 'ACGGG', 'ACGTG', 'TTTGG', 'CCCCC', 'ACCGG'][1 + o_orderkey % 6]"


@query(f"""WITH RECURSIVE g AS (SELECT o_orderkey AS id, {_UMI} AS umi, o_custkey % 300 AS f, {DAY.format('o_orderdate')} // 4 AS t, o_orderkey % 4 > 0 AS mapped FROM orders),
l AS (SELECT id AS a, lag(id) OVER (PARTITION BY umi, f ORDER BY t, id) AS b, t - lag(t) OVER (PARTITION BY umi, f ORDER BY t, id) AS d FROM g WHERE mapped UNION ALL SELECT id, lag(id) OVER (PARTITION BY umi, t ORDER BY f, id), f - lag(f) OVER (PARTITION BY umi, t ORDER BY f, id) FROM g WHERE mapped),
m AS (SELECT a, b FROM l WHERE d <= 10 UNION SELECT x.id, y.id FROM g x JOIN g y ON x.f = y.f AND x.id <> y.id AND length(x.umi) = length(y.umi) AND substring(y.umi, 1, length(regexp_replace(x.umi, 'G+$', ''))) = regexp_replace(x.umi, 'G+$', '') WHERE NOT x.mapped AND x.umi LIKE '%G'),
s AS (SELECT a, b FROM m UNION SELECT b, a FROM m), c(o, r) AS (SELECT id, id FROM g UNION SELECT s.b, c.r FROM c JOIN s ON s.a = c.o) SELECT o AS id, min(r) AS merged FROM c GROUP BY 1""")
def umi_merges(spark, sf_dir):
    k = F.col("o_orderkey")
    g = table(spark, sf_dir, "orders").select(k.alias("id"), pick(["ACGTA", "ACGGG", "ACGTG", "TTTGG", "CCCCC", "ACCGG"], k % 6).alias("umi"), (F.col("o_custkey") % 300).alias("five"), F.floor(days("o_orderdate") / 4).alias("three"), (k % 4 > 0).alias("mapped"))
    return X.merged_groups(g, 10)


@query("""WITH r AS (SELECT DISTINCT l_partkey AS g, l_orderkey AS id, ['10M', '9M1I', '5M1D5M'][1 + l_linenumber % 3] AS cigar, l_quantity AS q FROM lineitem), n AS (SELECT g, cigar, count(*) AS n, max(struct_pack(q := q, id := id)).id AS template FROM r GROUP BY ALL)
SELECT g, template, cigar, round(n / sum(n) OVER (PARTITION BY g), 8) AS share FROM n QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, cigar DESC, template DESC) = 1""")
def indel_templates(spark, sf_dir):
    c = F.col
    r = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("g"), c("l_orderkey").alias("id"), pick(["10M", "9M1I", "5M1D5M"], c("l_linenumber") % 3).alias("cigar"), c("l_quantity").alias("qual")).distinct()
    return X.template_reads(r, "g").withColumn("share", F.round("share", 8))


@query("""WITH b AS (SELECT l_partkey AS g, l_linenumber AS p, ['A', 'C', 'G', 'T'][1 + l_suppkey % 4] AS base, CAST(l_quantity AS BIGINT) AS q, l_orderkey % 2 AS s FROM lineitem), u AS (SELECT g, p, base, sum(q) AS q, count(DISTINCT s) AS s FROM b GROUP BY ALL),
w AS (SELECT *, sum(q) OVER (PARTITION BY g, p) AS t, count(*) OVER (PARTITION BY g, p) AS k, row_number() OVER (PARTITION BY g, p ORDER BY q DESC, base) AS n FROM u)
SELECT g, p, CASE WHEN k > 1 AND s < 2 AND 2 * q - t <= 0 THEN 'N' ELSE base END AS base, (CASE WHEN k > 1 AND s < 2 AND 2 * q - t <= 0 THEN 0 ELSE greatest(0, 2 * q - t) END)::BIGINT AS qual FROM w WHERE n = 1""")
def strand_consensus(spark, sf_dir):
    c = F.col
    b = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("g"), c("l_linenumber").alias("p"), pick("ACGT", c("l_suppkey") % 4).alias("base"), c("l_quantity").cast("long").alias("qual"), (c("l_orderkey") % 2).alias("strand"))
    return X.consensus_by_place(b, ["g", "p"]).select("g", "p", "base", c("qual").cast("long").alias("qual"))


@query(f"""WITH r AS (SELECT l_orderkey AS name, l_linenumber AS n, max(l_suppkey % 2) AS c, max({DAY.format('l_shipdate')}) AS s, max(l_partkey % 3) AS i FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), j AS (SELECT a.name, a.c, a.s, a.s + 60 AS e, a.i, b.c AS c2, b.s AS s2, b.s + 60 AS e2, b.i AS i2 FROM r a JOIN r b ON a.name = b.name AND a.n = 1 AND b.n = 2),
o AS (SELECT *, least(e, e2) - greatest(s, s2) + 1 AS v FROM j), k AS (SELECT *, CASE WHEN c <> c2 THEN 'DIFFERENT_CHROMOSOME' WHEN v <= 0 THEN 'NO_OVERLAP' WHEN i <> i2 THEN 'CIGAR_MISMATCH' ELSE 'COMBINED' END AS outcome FROM o)
SELECT name, CASE WHEN outcome = 'COMBINED' THEN least(s, s2) ELSE s END AS start, CASE WHEN outcome = 'COMBINED' THEN greatest(e, e2) ELSE e END AS "end", CASE WHEN outcome = 'COMBINED' THEN v ELSE 0 END AS overlap, outcome FROM k""")
def fragment_sync(spark, sf_dir):
    c = F.col
    r = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy(c("l_orderkey").alias("name"), "l_linenumber").agg(F.max(c("l_suppkey") % 2).alias("chromosome"), F.max("l_shipdate").alias("d"), F.max(c("l_partkey") % 3).alias("indels"))
    of = lambda n: r.filter(c("l_linenumber") == n).select("name", "chromosome", days("d").alias("start"), (days("d") + 60).alias("end"), "indels")
    return X.synced(of(1), of(2), "name")


def _tested(other: str, rate: str) -> str:
    r = f"greatest({rate}, 0.0001)"
    tail = f"(1 - list_sum(list_transform(generate_series(0, f - 1), lambda i: exp(lgamma(f + {other} + 1) - lgamma(i + 1) - lgamma(f + {other} - i + 1) + i * ln({r}) + (f + {other} - i) * ln(1 - {r})))))"
    near = f"f / (f + {other})::DOUBLE < CASE WHEN h AND {r} >= 0.03 THEN 1.5 ELSE 2.0 END * {r}"
    return f"CASE WHEN {other} > f AND f > 0 AND {tail} > 0.05 THEN CASE WHEN h THEN 1 ELSE 2 END WHEN {other} > f AND f > 0 AND ({tail} > 0.00025 OR {near}) THEN 1 ELSE 0 END"


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS f, CAST(l_quantity AS BIGINT) AS s, l_partkey % 40 AS g, l_discount / 4 AS rs, l_tax / 4 AS rl, l_suppkey % 6 = 0 AS h FROM lineitem),
w AS (SELECT *, greatest({_tested('s', 'rs')}, {_tested('g', 'rl')}, CASE WHEN least(s, g) > f THEN {_tested('(s + g)', '((rs + rl) / 2)')} ELSE 0 END) AS w FROM v) SELECT l_orderkey, l_linenumber, CASE w WHEN 2 THEN 'HARD' WHEN 1 THEN 'SOFT' ELSE 'NONE' END AS outcome FROM w""")
def jitter_outcomes(spark, sf_dir):
    c = F.col
    p = lambda k, n, r: N.binomial_cdf(k.cast("double"), n.cast("double"), r)
    out = X.jitter_outcome(c("l_linenumber").cast("long"), c("l_quantity").cast("long"), c("l_partkey") % 40, c("l_discount") / 4, c("l_tax") / 4, c("l_suppkey") % 6 == 0, p)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", out.alias("outcome"))


@query(f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS c, {DAY.format('o_orderdate')} AS s, {DAY.format('o_orderdate')} + 40 AS e FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT o_custkey AS c, {DAY.format('o_orderdate')} AS a, {DAY.format('o_orderdate')} + 5 AS b FROM orders WHERE o_orderkey % 9 = 0), m AS (SELECT o_custkey AS c, {DAY.format('o_orderdate')} + 20 AS a, {DAY.format('o_orderdate')} + 90 AS b, o_orderpriority AS k FROM orders WHERE o_orderkey % 3 = 0),
f AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.c = r.c AND s <= b + 50 AND a - 50 <= e)), n AS (SELECT id, k, sum(least(e, b) - greatest(s, a) + 1) AS n FROM f JOIN m ON f.c = m.c AND s <= b AND a <= e GROUP BY ALL), q AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, k) = 1)
SELECT f.id, k AS repeat FROM f LEFT JOIN q USING (id)""")
def off_target_regions(spark, sf_dir):
    o, k, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), days("o_orderdate")
    c = F.col("o_custkey").alias("chromosome")
    r = o.filter(k % 2 == 0).select(k.alias("id"), c, d.alias("start"), (d + 40).alias("end"))
    t = o.filter(k % 9 == 0).select(c, d.alias("start"), (d + 5).alias("end"))
    m = o.filter(k % 3 == 0).select(c, (d + 20).alias("start"), (d + 90).alias("end"), F.col("o_orderpriority").alias("repeat"))
    return X.off_target(r, t, m, 128, 50).select("id", "repeat")


@query(f"""WITH p AS (SELECT o_orderkey AS id, o_custkey AS c, {DAY.format('o_orderdate')} AS p FROM orders), g AS (SELECT c_custkey AS c, 8000 + 200 * i AS a, 8000 + 200 * i + 150 AS b, (c_custkey % 10) / 10.0::DOUBLE AS v FROM customer, unnest(generate_series(0, 12)) AS u(i)) SELECT id, coalesce(v, 1.0) AS mappability FROM p LEFT JOIN g ON p.c = g.c AND p BETWEEN a AND b""")
def mappability_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chromosome"), days("o_orderdate").alias("position"))
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chromosome"), ((F.col("c_custkey") % 10) / 10).alias("mappability"), F.explode(F.array(*[F.lit(8000 + 200 * i).cast("long") for i in range(13)])).alias("start"))
    return X.region_values(p, g.withColumn("end", F.col("start") + 150), "mappability", 1.0, 128).select("id", "mappability")


@query(f"SELECT l_suppkey AS s, {DAY.format('l_shipdate')} // 100 AS window_, count(*) AS n, round(avg(l_quantity), 8) AS mean_length, round(avg(l_discount), 8) AS mean_gc FROM lineitem GROUP BY ALL")
def window_fragments(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), days("l_shipdate").alias("start"), F.col("l_quantity").alias("length"), F.col("l_discount").alias("gc"))
    return X.window_fragments(f, ["s"], 100).select("s", F.col("window").alias("window_"), "n", F.round("mean_length", 8).alias("mean_length"), F.round("mean_gc", 8).alias("mean_gc"))


@query("""WITH r AS (SELECT l_returnflag AS f, 'r_' || l_suppkey % 16 AS name, repeat('ACGTG', CAST(l_linenumber AS INT)) AS b, l_linenumber * 5 AS n, CAST(l_partkey % 40 AS BIGINT) AS q FROM lineitem) SELECT f, count(*) AS reads, sum(n)::BIGINT AS bases, round(sum(n * 3 / 5) / sum(n), 8) AS gc, round(sum(n * q) / sum(n), 8) AS mean_quality, count(DISTINCT name) AS umis FROM r GROUP BY 1""")
def fastq_statistics(spark, sf_dir):
    c = F.col
    n = c("l_linenumber").cast("int")
    r = table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("f"), F.concat(F.lit("r_"), (c("l_suppkey") % 16).cast("string")).alias("name"), F.repeat(F.lit("ACGTG"), n).alias("bases"), F.repeat(F.char(33 + c("l_partkey") % 40), 5 * n).alias("qualities"))
    return X.file_statistics(r, ["f"]).withColumns({"gc": F.round("gc", 8), "mean_quality": F.round("mean_quality", 8)})


@query(f"WITH {SEQ} SELECT substring(x, 1, 1) AS repeat, length(x)::INT AS length, count(*) AS n FROM (SELECT unnest(regexp_extract_all(seq, 'AAA+|CCC+|GGG+|TTT+')) AS x FROM s) GROUP BY ALL")
def repeat_frequencies(spark, sf_dir):
    return X.repeat_frequencies(sequences(spark, sf_dir).select(F.col("seq").alias("sequence")), 1, 3)


@query(f"""WITH {SEQ}, w AS (SELECT doc_id, k::INT AS k, substring(seq, CAST(200 * k + 1 AS INT), 200) AS x FROM s, unnest(generate_series(0, (length(seq) - 1) // 200)) AS u(k) WHERE length(seq) > 0), d AS (SELECT doc_id, k, CASE WHEN length(x) >= 4 THEN (SELECT count(DISTINCT substring(x, CAST(i AS INT), 4)) / count(*)::DOUBLE FROM unnest(generate_series(1, length(x) - 3)) AS u(i)) END AS d FROM w) SELECT doc_id, k, round(d, 8) AS "distinct", d < 0.4 AS low FROM d""")
def low_complexity(spark, sf_dir):
    """Windows of 200 bases over whole sequences; the last one may be shorter."""
    w = sequences(spark, sf_dir).select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,200}"), F.lit(0))).alias("k", "x"))
    return X.low_complexity(w, "x", 4, 0.4).select("doc_id", "k", F.round("distinct", 8).alias("distinct"), "low")


@query("""WITH a AS (SELECT p_type AS x, p_brand AS y, p_partkey AS id, p_size AS q FROM part), b AS (SELECT *, substring(x || '            ', 1, 8) AS l, substring(y || '            ', 1, 8) AS r FROM a) SELECT id, (SELECT sum(CASE WHEN substring(l, CAST(i AS INT), 1) <> substring(r, CAST(i AS INT), 1) THEN CASE WHEN (q + i - 1) % 40 >= 20 THEN 1.0 ELSE 0.5 END ELSE 0 END) FROM unnest(generate_series(1, 8)) AS u(i))::DOUBLE AS penalty FROM b""")
def sequence_penalties(spark, sf_dir):
    c = F.col
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.rpad("p_type", 8, " ").alias("l"), F.rpad("p_brand", 8, " ").alias("r"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (c("p_size") + i) % 40).alias("q"))
    return p.select("id", X.tolerant_mismatch(c("l"), c("r"), c("q")).alias("penalty"))


@query(f"""WITH a AS (SELECT o_orderkey AS id, o_custkey AS c, {DAY.format('o_orderdate')} AS p, o_orderpriority AS q, o_totalprice AS s FROM orders), n AS (SELECT x.id FROM a x JOIN a y ON x.c = y.c AND abs(x.p - y.p) <= 100 AND length(x.q) = length(y.q) AND (y.s > x.s OR (y.s = x.s AND y.id < x.id)) WHERE len(list_filter(generate_series(1, length(x.q)), lambda i: substring(x.q, CAST(i AS INT), 1) <> substring(y.q, CAST(i AS INT), 1))) <= 2)
SELECT id, id NOT IN (SELECT id FROM n) AS kept FROM a""")
def assembly_dedup(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), days("o_orderdate").alias("position"), F.col("o_orderpriority").alias("sequence"), F.col("o_totalprice").alias("support"))
    return X.deduplicated_assemblies(a, ["c"], 100, 2)


@query()
def sv_chains(spark, sf_dir):
    k = F.col("o_orderkey")
    ends = table(spark, sf_dir, "orders").select(k.alias("breakend"), F.floor(k / 2).alias("variant"))
    links = table(spark, sf_dir, "orders").select(k.alias("a"), (k + 3 + k % 5).alias("b"), F.col("o_totalprice").alias("length")).filter("a % 3 = 0")
    known = ends.select(F.col("breakend").alias("b"))
    return X.chains(links.join(known, "b", "left_semi").select("a", "b", "length"), ends)

"""Receptors, alleles and peptides: words of texts and names stand for sequences of amino acids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import receptors as Z
from ..storage import table
from .registry import query
from .sv_queries import listed, pick

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
#: A matrix by rule, in place of a file's: 4 for equal letters, 1 for neighbours in the alphabet, else -2.
MATRIX = {a: {b: 4 if a == b else 1 if abs(LETTERS.index(a) - LETTERS.index(b)) == 1 else -2 for b in LETTERS} for a in LETTERS}
_M = f"CASE WHEN x = y THEN 4 WHEN abs(instr('{LETTERS}', x) - instr('{LETTERS}', y)) = 1 THEN 1 ELSE -2 END"
#: Peptides of eight letters from part names.
PEPTIDES = f"p AS (SELECT DISTINCT array_to_string(list_transform(generate_series(1, 8), lambda i: substring('{LETTERS}', 1 + CAST((p_partkey * (i + 3) + p_size * i * i) % 20 AS INT), 1)), '') AS peptide FROM part)"


def letter(index):
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), index.cast("int"))


def peptides(spark, sf_dir):
    c = F.col
    word = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: letter((c("p_partkey") * (i + 3) + c("p_size") * i * i) % 20)), "")
    return table(spark, sf_dir, "part").select(word.alias("peptide")).distinct()


ANCHORS = ["CASS", "CARD", "WGQG", "FGQG", "CAVN"]


@query(f"""WITH {PEPTIDES}, a AS (SELECT unnest({ANCHORS!r}) AS anchor), w AS (SELECT peptide, i - 1 AS pos, substring(peptide, CAST(i AS INT), 4) AS win FROM p, unnest(generate_series(1, 5)) AS u(i)),
s AS (SELECT peptide, pos, anchor, (3 * 4 - 6 + (SELECT sum({_M} - 4) FROM (SELECT substring(anchor, CAST(j AS INT), 1) AS x, substring(win, CAST(j AS INT), 1) AS y FROM unnest(generate_series(1, 4)) AS v(j))))::INT AS score FROM w, a)
SELECT peptide AS id, anchor, pos::INT AS "at", score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY score DESC, pos, anchor) = 1""")
def anchor_search(spark, sf_dir):
    p = peptides(spark, sf_dir).select(F.col("peptide").alias("id"), F.col("peptide").alias("sequence"))
    return Z.best_anchor(p, spark.createDataFrame([(a,) for a in ANCHORS], "anchor string"), MATRIX, 4)


_TESTS = {"PARTIAL": "NOT (v AND j)", "DUPLICATE": "n > 1 AND cdr3 <> ''", "CDR3_DELETED": "deleted", "MAX_LENGTH": "length(cdr3) / 3.0 >= 40", "MIN_LENGTH": "length(cdr3) / 3.0 < 5", "MATCHES_REF": "ref", "NO_HIGH_QUAL_SUPPORT": "NOT ok", "V_J_OVERLAP": "v AND j AND js < ve"}
SEQUENCES = f"""q AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS locus, repeat('ACGTTG', CAST((l_partkey % 23) AS INT)) AS cdr3, l_quantity AS support, l_suppkey % 9 > 0 AS v, l_orderkey % 8 > 0 AS j, l_partkey % 50 AS ve, 10 + l_suppkey % 60 AS js, l_partkey % 31 = 0 AS deleted, l_suppkey % 17 = 0 AS ref, l_linenumber < 7 AS ok, 94 + l_discount * 60 AS ident, l_extendedprice AS price FROM lineitem),
w AS (SELECT *, row_number() OVER (PARTITION BY locus, cdr3 ORDER BY support DESC, id, price) AS n FROM q), t AS (SELECT *, {listed(_TESTS)} AS f FROM w), s AS (SELECT *, CASE WHEN f = '' THEN 'PASS' ELSE f END AS filters FROM t)"""


def sequences(spark, sf_dir):
    c = F.col
    q = table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_returnflag").alias("locus"), F.repeat(F.lit("ACGTTG"), (c("l_partkey") % 23).cast("int")).alias("cdr3"), c("l_quantity").alias("support"), (c("l_suppkey") % 9 > 0).alias("v"), (c("l_orderkey") % 8 > 0).alias("j"),
        (c("l_partkey") % 50).alias("v_end"), (10 + c("l_suppkey") % 60).alias("j_start"), (c("l_partkey") % 31 == 0).alias("deleted"), (c("l_suppkey") % 17 == 0).alias("reference"), (c("l_linenumber") < 7).alias("supported"), (94 + c("l_discount") * 60).alias("identity"), c("l_extendedprice").alias("price"),
    )
    return Z.receptor_filters(q, "price")


@query(f"WITH {SEQUENCES} SELECT id, filters, CASE WHEN ident >= 98 THEN 'UNMUTATED' WHEN ident >= 97 THEN 'MUTATED_BORDERLINE' ELSE 'MUTATED' END AS shm FROM s")
def receptor_annotation(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", "filters", Z.hypermutation(F.col("identity")).alias("shm"))


@query(f"WITH {SEQUENCES}, r AS (SELECT l_returnflag AS locus, count(*) FILTER (l_tax < 0.05) AS reads_used, count(*) AS reads_total, count(*) > 1000 AS down_sampled FROM lineitem GROUP BY 1), n AS (SELECT locus, count(*) AS sequences, count(*) FILTER (filters = 'PASS') AS pass_sequences FROM s GROUP BY 1) SELECT * FROM r LEFT JOIN n USING (locus)")
def receptor_loci(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("locus"), (F.col("l_tax") < 0.05).alias("used"))
    return Z.locus_summary(r, sequences(spark, sf_dir), 1000)


HLA = """f AS (SELECT l_linenumber % 3 AS gene, l_orderkey AS fragment, l_partkey % 12 AS locus, ['A', 'C', 'G', 'T'][1 + (l_partkey % 12 * 3 + l_suppkey % 10 // 4 * (l_partkey % 2)) % 4] AS letter, l_discount > 0.01 AS high FROM lineitem),
e AS (SELECT gene, locus, letter, count(DISTINCT fragment) FILTER (high) AS n FROM f GROUP BY ALL), g AS (SELECT e.*, sum(n) OVER (PARTITION BY gene, locus) AS t FROM e), k AS (SELECT gene, locus, letter, n FROM g WHERE n >= greatest(2, 0.1 * t) AND n > 0)"""


def hla(spark, sf_dir):
    c = F.col
    at = c("l_partkey") % 12
    f = table(spark, sf_dir, "lineitem").select((c("l_linenumber") % 3).cast("long").alias("gene"), c("l_orderkey").alias("fragment"), at.alias("locus"), pick("ACGT", (at * 3 + F.floor(c("l_suppkey") % 10 / 4) * (c("l_partkey") % 2)) % 4).alias("letter"), (c("l_discount") > 0.01).alias("high"))
    return Z.locus_evidence(f, 2, 0.1)


@query(f"WITH {HLA} SELECT gene::BIGINT AS gene, locus, letter, n FROM k")
def hla_evidence(spark, sf_dir):
    return hla(spark, sf_dir)


@query(f"""WITH {HLA}, a AS (SELECT s_suppkey AS allele, s_suppkey % 3 AS gene, i AS locus, CASE WHEN (s_suppkey + i) % 11 = 0 THEN '*' ELSE ['A', 'C', 'G', 'T'][1 + (i * 3 + s_suppkey % 4 * (i % 2)) % 4] END AS letter FROM supplier, unnest(generate_series(0, 11)) AS u(i)), m AS (SELECT gene, locus FROM k GROUP BY ALL HAVING count(DISTINCT letter) > 1)
SELECT DISTINCT allele, gene FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y JOIN m ON y.gene = m.gene AND y.locus = m.locus WHERE y.allele = x.allele AND y.gene = x.gene AND y.letter <> '*' AND NOT EXISTS (SELECT 1 FROM k WHERE k.gene = y.gene AND k.locus = y.locus AND k.letter = y.letter))""")
def hla_candidates(spark, sf_dir):
    c = F.col
    a = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("allele"), (c("s_suppkey") % 3).alias("gene"), F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>")).alias("locus"))
    a = a.withColumn("letter", F.when((c("allele") + c("locus")) % 11 == 0, "*").otherwise(pick("ACGT", (c("locus") * 3 + c("allele") % 4 * (c("locus") % 2)) % 4)))
    return Z.surviving_alleles(a, hla(spark, sf_dir))


@query("""WITH a AS (SELECT l_suppkey AS s, l_partkey % 3 AS gene, 'A' || l_orderkey % 2 AS allele, sum(l_quantity) AS t, sum(l_linenumber) AS n FROM lineitem GROUP BY ALL), g AS (SELECT s_suppkey AS s, i AS gene, 2.0 + s_suppkey % 3 AS cn, (s_suppkey % 2) * 0.8 AS minor FROM supplier, unnest([0, 1, 2]) AS u(i)),
r AS (SELECT a.*, row_number() OVER (PARTITION BY s, gene ORDER BY t / n, allele) AS k FROM a) SELECT s AS sample, gene, allele, round(CASE WHEN k = 1 THEN minor ELSE cn - minor END::DOUBLE, 6) AS copies FROM r JOIN g USING (s, gene)""")
def hla_copy_number(spark, sf_dir):
    c = F.col
    a = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("sample"), (c("l_partkey") % 3).alias("gene"), F.concat(F.lit("A"), c("l_orderkey") % 2).alias("allele")).agg(F.sum("l_quantity").alias("tumor"), F.sum("l_linenumber").alias("normal"))
    s = c("s_suppkey")
    g = table(spark, sf_dir, "supplier").select(s.alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("gene"), (2.0 + s % 3).alias("min_cn"), ((s % 2) * 0.8).alias("minor"))
    return Z.allele_copies(a, g).withColumn("copies", F.round("copies", 6))


@query("""WITH f AS (SELECT DISTINCT l_partkey AS variant, l_orderkey AS fragment, 'A' || l_suppkey % 4 AS allele FROM lineitem), w AS (SELECT variant, allele, sum(x) AS w FROM (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY variant, fragment) AS x FROM f) GROUP BY ALL), b AS (SELECT * FROM w QUALIFY w >= max(w) OVER (PARTITION BY variant) - 1e-9)
SELECT variant, allele, round(1.0::DOUBLE / count(*) OVER (PARTITION BY variant), 8) AS weight FROM b""")
def hla_somatic(spark, sf_dir):
    c = F.col
    f = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("variant"), c("l_orderkey").alias("fragment"), F.concat(F.lit("A"), c("l_suppkey") % 4).alias("allele")).distinct()
    return Z.somatic_alleles(f).withColumn("weight", F.round("weight", 8))


@query("""WITH o AS (SELECT l_suppkey AS s, l_partkey % 3 AS gene, list_sort(list('A' || l_linenumber % 3)) AS a FROM lineitem GROUP BY ALL), n AS (SELECT l_suppkey AS s, l_partkey % 3 AS gene, list_sort(list('A' || l_linenumber % 3)) AS a FROM lineitem WHERE l_discount > 0.02 GROUP BY ALL)
SELECT coalesce(o.s, n.s) AS s, coalesce(o.gene, n.gene) AS gene, CASE WHEN coalesce(o.a, []) = coalesce(n.a, []) THEN 'MATCH' WHEN list_has_any(coalesce(o.a, []), coalesce(n.a, [])) THEN 'PARTIAL' ELSE 'DIFF' END AS status FROM o FULL JOIN n ON o.s = n.s AND o.gene = n.gene""")
def hla_compare(spark, sf_dir):
    c = F.col
    i = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("s"), (c("l_partkey") % 3).alias("gene"), F.concat(F.lit("A"), c("l_linenumber") % 3).alias("allele"), "l_discount")
    return Z.compared_types(i, i.filter("l_discount > 0.02"), "s")


@query("""WITH c AS (SELECT l_suppkey AS s, l_partkey % 5 AS gene, '*' || l_linenumber AS h, least(2, count(*)) AS n FROM lineitem GROUP BY ALL), f(gene, h, f, v) AS (SELECT g, '*' || k, ['Normal', 'Reduced', 'No function'][1 + (g + k) % 3], (g + k) % 3 FROM unnest([0, 1, 2, 3]) AS a(g), unnest([1, 2, 3, 4, 5]) AS b(k))
SELECT s AS sample, c.gene, string_agg(c.h || '_x' || n, ';' ORDER BY c.h || '_x' || n) AS haplotypes, coalesce(arg_max(f, v), 'Unknown') AS function, CASE WHEN count(f) = 0 THEN 'UNKNOWN' WHEN sum(n) = 2 THEN 'PASS' ELSE 'WARN' END AS qc FROM c LEFT JOIN f ON c.gene = f.gene AND c.h = f.h GROUP BY ALL""")
def haplotype_events(spark, sf_dir):
    c = F.col
    calls = table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("sample"), (c("l_partkey") % 5).alias("gene"), F.concat(F.lit("*"), "l_linenumber").alias("haplotype")).agg(F.least(F.lit(2), F.count("*")).alias("copies"))
    names = ["Normal", "Reduced", "No function"]
    f = spark.createDataFrame([(g, f"*{k}", names[(g + k) % 3], (g + k) % 3) for g in range(4) for k in range(1, 6)], "gene long, haplotype string, function string, severity int")
    return Z.haplotype_events(calls, f)


_SCORES = f"""{PEPTIDES}, w AS (SELECT a, i, x, ((a * 7 + i * 5 + instr('{LETTERS}', x) * 3) % 17 - 8) / 4.0::DOUBLE AS w FROM unnest([0, 1, 2]) AS t(a), unnest(generate_series(0, 7)) AS u(i), unnest(string_split('{LETTERS}', '')) AS v(x) WHERE x <> '' AND (i + instr('{LETTERS}', x)) % 5 <> 0),
l AS (SELECT a, peptide, i, substring(peptide, CAST(i + 1 AS INT), 1) AS x FROM p, unnest([0, 1, 2]) AS t(a), unnest(generate_series(0, 7)) AS u(i)), s AS (SELECT l.a, peptide, sum(coalesce(w, 0)) AS score FROM l LEFT JOIN w ON l.a = w.a AND l.i = w.i AND l.x = w.x GROUP BY ALL)"""


def scores(spark, sf_dir):
    rows = [(a, 8, i, x, ((a * 7 + i * 5 + (LETTERS.index(x) + 1) * 3) % 17 - 8) / 4) for a in range(3) for i in range(8) for x in LETTERS if (i + LETTERS.index(x) + 1) % 5]
    w = spark.createDataFrame(rows, "allele int, length int, position int, residue string, weight double")
    p = peptides(spark, sf_dir).withColumn("allele", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return Z.peptide_scores(p, w)


@query(f"WITH {_SCORES} SELECT a::INT AS allele, peptide, round(score, 6) AS score FROM s")
def peptide_scores(spark, sf_dir):
    return scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query()
def peptide_ranks(spark, sf_dir):
    s = scores(spark, sf_dir)
    r = s.filter(F.xxhash64("peptide") % 2 == 0)
    return Z.score_ranks(s, r, ["allele"], 20).select("allele", "peptide", F.round("rank", 6).alias("rank"))


@query(f"""WITH {_SCORES}, r AS (SELECT a, peptide, score / 100 AS rank FROM s), e AS (SELECT p_size AS gene, avg(p_retailprice) AS tpm FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), m AS (SELECT p_size AS gene, median(p_retailprice) AS m FROM part GROUP BY 1), x AS (SELECT peptide, 1 AS a, (instr('{LETTERS}', substring(peptide, 1, 1)) + instr('{LETTERS}', substring(peptide, 8, 1))) % 60 AS gene FROM p)
SELECT x.peptide, gene, round(rank, 6) AS rank, round(coalesce(tpm, m), 6) AS tpm, round(coalesce(tpm, m) / m, 6) AS ratio FROM x LEFT JOIN r USING (peptide, a) LEFT JOIN e USING (gene) LEFT JOIN m USING (gene)""")
def epitope_scores(spark, sf_dir):
    c = F.col
    x = peptides(spark, sf_dir).select("peptide", F.lit(1).alias("allele"), ((_index("peptide", 1) + _index("peptide", 8)) % 60).cast("int").alias("gene"))
    part = table(spark, sf_dir, "part")
    e = part.filter("p_partkey % 2 = 0").groupBy(c("p_size").alias("gene")).agg(F.avg("p_retailprice").alias("tpm"))
    m = part.groupBy(c("p_size").alias("gene")).agg(F.percentile("p_retailprice", 0.5).alias("median"))
    r = scores(spark, sf_dir).select("allele", "peptide", (c("score") / 100).alias("rank"))
    return Z.scored_epitopes(x, r, e, m).select("peptide", "gene", *[F.round(k, 6).alias(k) for k in ("rank", "tpm", "ratio")])


def _index(name, at):
    """Place of a letter in the alphabet, from 1."""
    return F.array_position(F.array(*[F.lit(x) for x in LETTERS]), F.substring(name, at, 1))


@query(f"""WITH {PEPTIDES}, k AS (SELECT peptide AS known FROM p WHERE substring(peptide, 1, 1) < 'H'), q AS (SELECT peptide FROM p WHERE substring(peptide, 1, 1) >= 'H' OR substring(peptide, 2, 1) < 'D'), d AS (SELECT peptide, known, (SELECT count(*) FILTER (x <> y) FROM (SELECT substring(known, CAST(j AS INT), 1) AS x, substring(peptide, CAST(j AS INT), 1) AS y FROM unnest(generate_series(1, 8)) AS v(j))) AS n, (SELECT sum({_M} - 4) FROM (SELECT substring(known, CAST(j AS INT), 1) AS x, substring(peptide, CAST(j AS INT), 1) AS y FROM unnest(generate_series(1, 8)) AS v(j))) AS g FROM q, k)
SELECT peptide, known, n::INT AS differences, (3 * 8 - 6 + g)::INT AS score FROM d WHERE n <= 4 QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY g DESC, n, known) = 1""")
def nearest_epitope(spark, sf_dir):
    p = peptides(spark, sf_dir)
    first, second = F.substring("peptide", 1, 1), F.substring("peptide", 2, 1)
    return Z.nearest_known(p.filter((first >= "H") | (second < "D")), p.filter(first < "H").select(F.col("peptide").alias("known")), MATRIX, 4)


@query("SELECT l_suppkey, count(*) AS n, round(count(*) FILTER (l_discount <= 0.02) / count(*)::DOUBLE, 8) AS tpr_0, round(count(*) FILTER (l_discount <= 0.05) / count(*)::DOUBLE, 8) AS tpr_1 FROM lineitem GROUP BY 1")
def binder_validation(spark, sf_dir):
    out = Z.true_positive_rates(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_discount").alias("rank")), ["l_suppkey"], [0.02, 0.05])
    return out.select("l_suppkey", "n", F.round("tpr_0", 8).alias("tpr_0"), F.round("tpr_1", 8).alias("tpr_1"))

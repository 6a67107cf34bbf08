"""Haplotypes, variants behind proteins and residues across fusions: orders stand for fragments and fusions, items for their places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import haplotypes as H
from ..operators import reverse as R
from ..storage import table
from .impact_queries import _TRANSLATE, MODEL, model
from .registry import query

#: Letters of two haplotypes by place; every seventeenth is another one's, every thirtieth none that is supported.
PLACES = "p AS (SELECT o.o_custkey % 20 AS gene, l_orderkey AS fragment, l_linenumber AS locus, CASE WHEN l_partkey % 30 = 0 THEN 'T' WHEN ((l_orderkey // 20 + l_linenumber) % 2 = 0) <> (l_partkey % 17 = 0) THEN 'A' ELSE 'C' END AS letter FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey)"


def places(spark, sf_dir):
    """Fragments and supported letters."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    even = (F.floor(c("l_orderkey") / 20) + c("l_linenumber")) % 2 == 0
    letter = F.when(c("l_partkey") % 30 == 0, "T").when(even != (c("l_partkey") % 17 == 0), "A").otherwise("C")
    f = rows.select((c("o_custkey") % 20).alias("gene"), c("l_orderkey").alias("fragment"), c("l_linenumber").cast("int").alias("locus"), letter.alias("letter"))
    return f, f.filter("letter != 'T'").select("gene", "locus", "letter").distinct()


@query(f"""WITH {PLACES}, e AS (SELECT gene, locus, list(DISTINCT letter) FILTER (letter <> 'T') AS letters FROM p GROUP BY ALL), u AS (SELECT gene, locus, lead(locus) OVER (PARTITION BY gene ORDER BY locus) AS next FROM e WHERE len(letters) > 1),
h AS (SELECT gene, fragment, locus, min(letter) AS letter FROM p WHERE letter <> 'T' GROUP BY ALL HAVING count(DISTINCT letter) = 1)
SELECT gene, a.locus::INT AS locus, next::INT AS next, a.letter AS a, b.letter AS b, count(*) AS n FROM h a JOIN u USING (gene, locus) JOIN h b USING (gene, fragment) WHERE b.locus = next GROUP BY ALL""")
def phased_pairs(spark, sf_dir):
    return H.phased_pairs(*places(spark, sf_dir), ["gene"])


@query()
def phased_haplotypes(spark, sf_dir):
    got = H.phased_haplotypes(*places(spark, sf_dir), ["gene"])
    return got.select("gene", "first", "last", F.array_join("loci", ",").alias("loci"), "haplotype", "n")


@query()
def agreeing_alleles(spark, sf_dir):
    """Parts stand for alleles, of which a gene has those with its number."""
    c = F.col
    haplotypes = H.phased_haplotypes(*places(spark, sf_dir), ["gene"])
    locus = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("locus")
    alleles = table(spark, sf_dir, "part").select(c("p_partkey").alias("allele"), (c("p_partkey") % 20).alias("gene"), locus)
    letter = F.when((c("allele") + c("locus")) % 11 == 0, "*").when((F.floor(c("allele") / 20) + c("locus")) % 2 == 0, "A").otherwise("C")
    return H.agreeing_alleles(alleles.withColumn("letter", letter), haplotypes, ["gene"])


@query(f"""WITH {MODEL}, y AS (SELECT transcript, greatest(es, cs) AS gs, least(ee, ce) AS ge, strand FROM t JOIN x USING (transcript) WHERE cs IS NOT NULL AND greatest(es, cs) <= least(ee, ce)),
f AS (SELECT o_orderkey AS id, u.transcript AS ut, d.transcript AS dt, u.ts + o_custkey * 7 % 260 AS up, d.ts + o_orderkey * 11 % 260 AS dp, ['', 'A', 'GC', 'ACG'][1 + o_orderkey % 4] AS ins, u.strand AS us, d.strand AS ds FROM orders JOIN t u ON u.transcript = 1 + o_custkey % (SELECT max(s_suppkey) FROM supplier) JOIN t d ON d.transcript = 1 + o_orderkey % (SELECT max(s_suppkey) FROM supplier) WHERE u.cs IS NOT NULL AND d.cs IS NOT NULL),
uo AS (SELECT id, sum(greatest(0, CASE WHEN us > 0 THEN least(ge, up) - gs + 1 ELSE ge - greatest(gs, up) + 1 END)) AS uo FROM f JOIN y ON y.transcript = ut GROUP BY 1), dd AS (SELECT id, sum(greatest(0, CASE WHEN ds > 0 THEN least(ge, dp - 1) - gs + 1 ELSE ge - greatest(gs, dp + 1) + 1 END)) AS dn FROM f JOIN y ON y.transcript = dt GROUP BY 1),
j AS (SELECT id, dn, ins, substring(a.bases, 1, CAST(uo AS INT)) AS head, substring(b.bases, CAST(dn + 1 AS INT)) AS tail FROM f JOIN uo USING (id) JOIN dd USING (id) JOIN q a ON a.transcript = ut JOIN q b ON b.transcript = dt), k AS (SELECT *, length(head) + length(ins) AS n, head || ins || tail AS s FROM j),
r AS (SELECT *, coalesce((SELECT string_agg({_TRANSLATE.format('substring(s, CAST(3 * i + 1 AS INT), 3)')}, '' ORDER BY i) FROM unnest(generate_series(0, length(s) // 3 - 1)) AS u(i)), '') AS aa, (n - dn) % 3 = 0 AND length(head) > 0 AND length(tail) > 0 AS fr FROM k), z AS (SELECT *, contains(aa, '*') AS stopped, split_part(aa, '*', 1) AS p, length(head) // 3 AS lo FROM r),
w AS (SELECT *, greatest(lo, CASE WHEN fr THEN CAST(ceil(n / 3.0) AS INT) ELSE length(p) END) AS hi FROM z) SELECT id, fr AS in_frame, substring(p, CAST(greatest(0, lo - 10) + 1 AS INT), CAST(least(10, lo) AS INT)) AS upstream, substring(p, CAST(lo + 1 AS INT), CAST(hi - lo AS INT)) AS novel, CASE WHEN fr THEN substring(p, CAST(hi + 1 AS INT), 10) ELSE '' END AS downstream, stopped FROM w""")
def fusion_peptides(spark, sf_dir):
    c = F.col
    _, t, e, q = model(spark, sf_dir)
    last = t.agg(F.max("transcript")).first()[0]
    starts = t.select("transcript", "trans_start")
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), (1 + c("o_custkey") % last).alias("up_transcript"), (1 + c("o_orderkey") % last).alias("down_transcript"), (c("o_custkey") * 7 % 260).alias("x"), (c("o_orderkey") * 11 % 260).alias("y"), F.get(F.array(*[F.lit(x) for x in ("", "A", "GC", "ACG")]), (c("o_orderkey") % 4).cast("int")).alias("insert"))
    o = o.join(starts.select(c("transcript").alias("up_transcript"), c("trans_start").alias("us")), "up_transcript").join(starts.select(c("transcript").alias("down_transcript"), c("trans_start").alias("ds")), "down_transcript")
    f = o.select("id", "up_transcript", (c("us") + c("x")).alias("up_position"), "down_transcript", (c("ds") + c("y")).alias("down_position"), "insert")
    return R.fusion_peptides(f, t, e, q)


@query()
def variants_behind_proteins(spark, sf_dir):
    """Changes of residues 1 to 45 of transcripts: an item's residue becomes one of eight, or goes, or is doubled."""
    c = F.col
    _, t, e, q = model(spark, sf_dir)
    k = (1 + c("l_partkey") % 45).cast("int")
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", *[c(x).cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), c("l_suppkey").alias("transcript"), k.alias("k"), "l_linenumber").distinct().join(q, "transcript")
    own = R.translated(F.substring("bases", 3 * (c("k") - 1) + 1, F.lit(3)))
    to = F.get(F.array(*[F.lit(x) for x in "ACDEL*=R"]), (c("k") % 8).cast("int"))
    change = F.concat(F.lit("p."), own, c("k").cast("string"), F.when(c("l_linenumber") == 1, "del").when(c("l_linenumber") == 2, "dup").otherwise(to))
    return R.variants_behind(items.select("id", "transcript", change.alias("protein")), t, e, q)

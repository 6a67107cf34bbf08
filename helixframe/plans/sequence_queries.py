"""Sequence queries: the letters a, c, g and t of a document's text stand for its bases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as Q
from ..storage import table
from .registry import query

SEQ = "s AS (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '[^acgt]', '', 'g')) AS seq FROM documents)"
REV = "translate(reverse({}), 'ACGT', 'TGCA')"


def sequences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^acgt]", "")).alias("seq"))


@query(f"WITH {SEQ} SELECT doc_id, md5({REV.format('seq')}) AS digest FROM s")
def revcomp(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.md5(Q.reverse_complement(F.col("seq"))).alias("digest"))


@query(f"WITH {SEQ} SELECT doc_id, CASE WHEN length(seq) > 0 THEN round((length(seq) - length(translate(seq, 'GC', ''))) / length(seq)::DOUBLE, 8) END AS gc FROM s")
def gc_content(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.round(Q.gc_content(F.col("seq")), 8).alias("gc"))


@query(f"WITH {SEQ}, k AS (SELECT doc_id, unnest(list_transform(generate_series(1, length(seq) - 11), lambda i: substring(seq, i, 12))) AS k FROM s WHERE length(seq) >= 12) SELECT k, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY 1")
def kmer_count(spark, sf_dir):
    k = sequences(spark, sf_dir).select("doc_id", F.explode(Q.kmers(F.col("seq"), 12)).alias("k"))
    # By document first: most repeats are within one, and what is shuffled to the k-mer's own task is one row for each of its documents at most.
    return k.groupBy("k", "doc_id").agg(F.count("*").alias("n")).groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) >= 5), q AS (SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM b WHERE len(w) >= 5)
SELECT item_id, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM q JOIN g USING (g) GROUP BY 1""")
def kmer_locate(spark, sf_dir):
    """Where runs of five words of an item stand: shingles are joined on equality."""
    five = lambda w: F.transform(F.when(F.size(w) >= 5, F.sequence(F.lit(1), F.size(w) - 4)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(w, i, F.lit(5)), " "))
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))  # split once, not for every shingle
    docs = words.select("doc_id", F.explode(five(F.col("w"))).alias("g"))
    wanted = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("w")).select("item_id", F.explode(five(F.col("w"))).alias("g")).distinct()
    return docs.join(wanted, "g").groupBy("item_id").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query(f"""WITH {SEQ} SELECT doc_id, greatest(len(regexp_extract_all(seq, 'TTAGGG')), len(regexp_extract_all(seq, 'CCCTAA')))::INT AS repeats, len(regexp_extract_all(seq, 'TTA'))::INT AS motif FROM s""")
def telomere_motifs(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", Q.telomere_repeats(F.col("seq")).alias("repeats"), F.regexp_count("seq", F.lit("TTA")).alias("motif"))


TRI = f"""WITH {SEQ}, t AS (SELECT doc_id, unnest(list_transform(generate_series(1, length(seq) - 3), lambda i: substring(seq, i, 4))) AS c FROM s WHERE length(seq) >= 4),
v AS (SELECT substring(c, 2, 1) AS r, substring(c, 4, 1) AS a, substring(c, 1, 3) AS x FROM t WHERE substring(c, 2, 1) <> substring(c, 4, 1))
SELECT CASE WHEN r IN ('A', 'G') THEN translate(r, 'AG', 'TC') || '>' || translate(a, 'ACGT', 'TGCA') || '_' || {REV.format('x')} ELSE r || '>' || a || '_' || x END AS bucket, count(*) AS n FROM v GROUP BY 1"""


@query(TRI)
def trinucleotide_counts(spark, sf_dir):
    c = sequences(spark, sf_dir).select(F.explode(Q.kmers(F.col("seq"), 4)).alias("c"))
    r, a, x = F.substring("c", 2, 1), F.substring("c", 4, 1), F.substring("c", 1, 3)
    return c.filter(r != a).select(Q.trinucleotide(r, a, x).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


AA = "".join(f" WHEN '{c}' THEN '{a}'" for c, a in Q.CODONS.items())


@query(f"""WITH {SEQ}, c AS (SELECT doc_id, i, CASE substring(seq, i * 3 - 2, 3){AA} ELSE 'X' END AS a FROM s, unnest(generate_series(1, length(seq) // 3)) AS u(i))
SELECT s.doc_id, md5(coalesce(p, '')) AS protein, length(coalesce(p, '')) AS n FROM s LEFT JOIN (SELECT doc_id, string_agg(a, '' ORDER BY i) AS p FROM c GROUP BY 1) USING (doc_id)""")
def amino_acids(spark, sf_dir):
    p = Q.translated(F.col("seq"))
    return sequences(spark, sf_dir).select("doc_id", p.alias("p")).select("doc_id", F.md5("p").alias("protein"), F.length("p").cast("long").alias("n"))


@query("""WITH b AS (SELECT DISTINCT p_type || ' ' || p_brand AS x FROM part) SELECT a.x AS a, b.x AS b FROM b a JOIN b ON a.x < b.x AND length(a.x) = length(b.x) WHERE len(list_filter(generate_series(1, length(a.x)), lambda i: substring(a.x, i, 1) <> substring(b.x, i, 1))) <= 2""")
def hamming_pairs(spark, sf_dir):
    """Distinct names within two substitutions: of three thirds one is equal then, so names meet by thirds."""
    b = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" "), F.col("p_brand")).alias("x")).distinct()
    n = F.length("x")
    third = F.array(*[F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring("x", F.floor(n * i / 3).cast("int") + 1, (F.floor(n * (i + 1) / 3) - F.floor(n * i / 3)).cast("int")).alias("t")) for i in range(3)])
    keyed = b.select("x", F.explode(third).alias("k"))
    pairs = keyed.select(F.col("x").alias("a"), "k").join(keyed.select(F.col("x").alias("b"), "k"), "k").filter("a < b").select("a", "b").distinct()
    return pairs.filter(Q.hamming_within(F.col("a"), F.col("b"), 2))


@query("""SELECT l_orderkey, l_linenumber, m + 2 * i + s AS read_length, m + d AS reference_length, s AS clip, CASE WHEN 30 < s OR (30 >= s + m // 2 AND 30 < s + m // 2 + 2 * i) OR 30 >= s + m + 2 * i THEN NULL WHEN 30 < s + m // 2 THEN 1000 + 30 - s ELSE 1000 + 30 - s - 2 * i + d END AS position
FROM (SELECT l_orderkey, l_linenumber, 20 + 2 * CAST(l_quantity AS BIGINT) AS m, l_linenumber::BIGINT AS i, l_suppkey % 9 AS d, l_partkey % 12 AS s FROM lineitem)""")
def cigar_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (20 + 2 * F.col("l_quantity").cast("long")).alias("m"), F.col("l_linenumber").cast("long").alias("i"), (F.col("l_suppkey") % 9).alias("d"), (F.col("l_partkey") % 12).alias("s"))
    half = (F.col("m") / 2).cast("long")
    part = lambda n, o: F.when(n > 0, F.concat(n.cast("string"), F.lit(o))).otherwise("")
    cigar = F.concat(part(F.col("s"), "S"), part(half, "M"), part(2 * F.col("i"), "I"), part(F.col("d"), "D"), part(half, "M"))
    c = rows.withColumn("cigar", cigar)
    return c.select("l_orderkey", "l_linenumber", Q.cigar_length(F.col("cigar"), "MIS=X").alias("read_length"), Q.cigar_length(F.col("cigar"), "MDN=X").alias("reference_length"), Q.soft_clip(F.col("cigar"), True).cast("long").alias("clip"), Q.reference_position(F.col("cigar"), F.lit(1000), F.lit(30)).alias("position"))


@query("""SELECT l_orderkey, l_linenumber, 'c.' || CASE WHEN l_linenumber = 1 THEN l_partkey || 'A>G' WHEN l_linenumber = 2 THEN l_partkey || 'del' WHEN l_linenumber = 3 THEN l_partkey || '_' || (l_partkey + 1) || 'insTT' WHEN l_linenumber = 4 THEN l_partkey || '_' || (l_partkey + 2) || 'del' ELSE l_partkey || '_' || (l_partkey + 1) || 'delinsGCA' END AS hgvs, l_partkey AS start FROM lineitem""")
def hgvs(spark, sf_dir):
    n = F.col("l_linenumber")
    ref = F.when(n == 1, "A").when(n == 2, "C").when(n == 3, "").when(n == 4, "ACG").otherwise("AC")
    alt = F.when(n == 1, "G").when(n == 2, "").when(n == 3, "TT").when(n == 4, "").otherwise("GCA")
    text = Q.hgvs_coding(F.col("l_partkey"), ref, alt)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("hgvs")).withColumn("start", Q.hgvs_parts(F.col("hgvs"))["start"].cast("long"))


@query("SELECT c_custkey, sha256(c_custkey::VARCHAR || 'salt') AS id FROM customer")
def id_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", Q.hashed_id(F.col("c_custkey"), "salt").alias("id"))

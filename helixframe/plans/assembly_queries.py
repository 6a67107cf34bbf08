"""Comparison and assembly: documents stand for sequences (their letters as bases), from which reads are cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from ..storage import table
from .registry import days, query
from .sequence_queries import SEQ, sequences

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


@query(f"""WITH b AS (SELECT o_orderkey AS id, o_custkey % 25 AS c, {DAY.format('o_orderdate')} AS p, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS o FROM orders), k AS (SELECT c_custkey AS variant, i AS breakend, c_custkey % 25 AS c, 8036 + (c_custkey * 37 + i * 19) % 2500 AS p, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END AS o FROM customer, unnest([0, 1]) AS u(i)),
n AS (SELECT id, variant, breakend, abs(b.p - k.p) AS distance, b.o <> k.o AS other FROM b JOIN k ON b.c = k.c AND abs(b.p - k.p) <= 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, other, variant, breakend) = 1) SELECT id, variant, breakend, distance FROM b LEFT JOIN n USING (id)""")
def known_site_matches(spark, sf_dir):
    k = F.col("o_orderkey")
    b = table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 25).alias("chromosome"), days("o_orderdate").alias("position"), F.when(k % 2 == 0, 1).otherwise(-1).alias("orientation"))
    c = F.col("c_custkey")
    i = F.explode(F.array(F.lit(0), F.lit(1))).alias("breakend")
    known = table(spark, sf_dir, "customer").select(c.alias("variant"), i, (c % 25).alias("chromosome"), F.when(c % 3 == 0, 1).otherwise(-1).alias("orientation")).withColumn("position", 8036 + (F.col("variant") * 37 + F.col("breakend") * 19) % 2500)
    return A.nearest_known(b, known, 4).select("id", "variant", "breakend", "distance")


def _windows(spark, sf_dir, size: int, step: int):
    """(doc_id, k, x): every window of ``size`` bases, ``step`` apart, of each whole sequence."""
    s = sequences(spark, sf_dir).filter(F.length("seq") >= size)
    # What lies ahead of each place, in one pass over the sequence.
    every = F.regexp_extract_all("seq", F.lit(f"(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1))
    return s.select("doc_id", F.posexplode(every).alias("k", "x"))


@query()
def tolerant_comparison(spark, sf_dir):
    """Windows that cover each whole sequence against themselves with a base of one quality changed, one lost, and a run that is three bases longer; the penalties follow."""
    parts = F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,120}"), F.lit(0))).alias("k", "s")  # the last one may be shorter
    w = sequences(spark, sf_dir).select("doc_id", parts)
    at = (10 + (F.col("doc_id") + F.col("k") * 7) % 60).cast("int")
    from_ = lambda n, size: F.substring("s", at + n + 1, F.lit(size))
    head, run = F.substring("s", F.lit(1), at), from_(32, 1)
    # A run of 13 is put before the base at 32 beyond the change, which makes it one of 14 or more; it has three more in the other.
    x = F.concat(head, from_(0, 32), F.repeat(run, 13), from_(32, 120))
    changed = F.concat(head, F.translate(from_(0, 1), "ACGT", "CGTA"), from_(1, 20), from_(22, 10), F.repeat(run, 16), from_(32, 120))
    w = w.select("doc_id", "k", x.alias("x"), changed.alias("y"), at.alias("at"))
    quality = F.concat(F.repeat(F.lit("I"), F.col("at")), F.char(33 + (F.lit(20) + 8 * (F.col("k") % 3)).cast("int")), F.repeat(F.lit("I"), F.length("x") - F.col("at") - 1))
    pairs = w.select("doc_id", "k", "x", F.substring(quality, F.lit(1), F.length("x")).alias("q"), "y", F.repeat(F.lit("I"), F.length("y")).alias("u"))
    return A.compared(pairs, "x", "q", "y", "u").select("doc_id", "k", F.round("penalty", 6).alias("penalty"), "overlap", "alike")


@query(f"""WITH {SEQ}, j AS (SELECT doc_id, seq, p FROM s, unnest(generate_series(100, length(seq) - 101, 600)) AS u(p)) SELECT doc_id * 100000 + p AS junction, substring(seq, CAST(p - 56 + 1 AS INT), 117) AS sequence, 56 AS junction_at, 6 AS support, 6 AS fragments FROM j""")
def junction_assembly(spark, sf_dir):
    """Six reads over every junction, 600 bases apart; one base of each is wrong and of low quality."""
    s = sequences(spark, sf_dir).filter(F.length("seq") >= 201)
    # Parts of 600 bases and what lies ahead of them: a junction 100 bases into a part has its reads within 201.
    part = F.posexplode(F.regexp_extract_all("seq", F.lit("(?=(.{201})).{1,600}"), F.lit(1))).alias("k", "x")
    r = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("r")
    junctions = s.select("doc_id", part).select((F.col("doc_id") * 100000 + 100 + 600 * F.col("k")).alias("junction"), "x", r)
    whole = F.substring("x", (100 - 20 - 9 * F.col("r") + 1).cast("int"), F.lit(90))
    wrong = (20 + F.col("r") * 11).cast("int")
    bases = F.concat(F.substring(whole, F.lit(1), wrong), F.translate(F.substring(whole, wrong + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(whole, wrong + 2, F.lit(90)))
    quality = F.concat(F.repeat(F.lit("I"), wrong), F.lit("+"), F.repeat(F.lit("I"), 89 - wrong))
    name = F.concat_ws("_", F.col("junction").cast("string"), F.col("r").cast("string"))
    reads = junctions.select("junction", name.alias("read"), name.alias("fragment"), bases.alias("bases"), quality.alias("qualities"), (20 + 9 * F.col("r")).cast("int").alias("at"))
    return A.assembled(reads).select("junction", "sequence", "junction_at", "support", "fragments")


@query()
def assembly_links(spark, sf_dir):
    """Windows of 260 bases, 200 apart, stand for assemblies; neighbours share two fragments, and so one sequence's windows are a phase group."""
    w = _windows(spark, sf_dir, 260, 200)
    junction = F.col("doc_id") * 10000 + F.col("k")
    assemblies = w.select(junction.cast("string").alias("id"), junction.alias("junction"), F.col("x").alias("sequence"), F.repeat(F.lit("I"), 260).alias("qualities"))
    shared = F.explode(F.array(*[F.concat_ws("_", (junction + d).cast("string"), F.lit(x)) for d in (0, 1) for x in "ab"])).alias("fragment")
    return A.linked(assemblies, A.phase_groups(w.select(junction.alias("junction"), shared))).select("a", "b", "turned", "overlap", F.round("penalty", 6).alias("penalty"))

"""Effects of variants: suppliers stand for transcripts with three exons each, items for variants in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import CODONS
from ..operators import impact as E
from ..storage import table
from .registry import query
from .sv_queries import pick

BASES = ["A", "C", "G", "T"]
#: Transcripts of three exons of 60 bases with introns of 40 from position 1000 on; coding from 1020 to 1240; every fifth has no protein. Sequences are made from the letters of the transcript's number.
MODEL = """t AS (SELECT s_suppkey AS transcript, s_suppkey // 2 AS gene, s_suppkey % 3 AS chromosome, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END AS strand, 1000 + 2000 * (s_suppkey // 3) AS ts, 1259 + 2000 * (s_suppkey // 3) AS te, CASE WHEN s_suppkey % 5 <> 0 THEN 1020 + 2000 * (s_suppkey // 3) END AS cs, CASE WHEN s_suppkey % 5 <> 0 THEN 1240 + 2000 * (s_suppkey // 3) END AS ce FROM supplier),
x AS (SELECT transcript, ts + 100 * i AS es, ts + 100 * i + 59 AS ee FROM t, unnest([0, 1, 2]) AS u(i)), q AS (SELECT transcript, 'ATG' || string_agg(substring('ACGTTGCAAG', 1 + CAST((transcript * 7 + i * i) % 10 AS INT), 1), '' ORDER BY i) AS bases FROM t, unnest(generate_series(1, 150)) AS u(i) GROUP BY 1),
v AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_suppkey % 3 AS chromosome, 200 + 2000 * (l_suppkey // 3) + (l_orderkey * 13 + l_partkey * 31 + l_linenumber) % 1400 AS p, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'AC' WHEN 3 THEN 'ACG' ELSE ['A', 'C', 'G', 'T'][1 + l_partkey % 4] END AS ref, CASE l_linenumber WHEN 1 THEN 'GG' WHEN 2 THEN '' WHEN 3 THEN '' ELSE ['A', 'C', 'G', 'T'][1 + (l_partkey + 1 + l_orderkey % 3) % 4] END AS alt, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey * 10 + l_orderkey % 2 END AS lps FROM lineitem)"""
_TRANSLATE = "CASE {}" + "".join(f" WHEN '{c}' THEN '{a}'" for c, a in CODONS.items()) + " ELSE 'X' END"
#: Residues of a text of whole codons.
_RESIDUES = "coalesce((SELECT string_agg({}, '' ORDER BY i) FROM unnest(generate_series(0, length({}) // 3 - 1)) AS u(i)), '')"


def _residues(x: str) -> str:
    return _RESIDUES.format(_TRANSLATE.format(f"substring({x}, CAST(3 * i + 1 AS INT), 3)"), x)


EFFECTS = f"""{MODEL}, m AS (SELECT *, p + greatest(length(ref), 1) - 1 AS q FROM v), n AS (SELECT m.*, t.* EXCLUDE (chromosome), x.es, x.ee FROM m JOIN t ON m.chromosome = t.chromosome AND p <= te + CASE WHEN strand > 0 THEN 0 ELSE 1000 END AND m.q >= ts - CASE WHEN strand > 0 THEN 1000 ELSE 0 END JOIN x ON x.transcript = t.transcript),
d AS (SELECT *, CASE WHEN ee <> te AND p - ee BETWEEN -2 AND 8 THEN p - ee END AS de, CASE WHEN es <> ts AND es - p BETWEEN -2 AND 8 THEN es - p END AS ds, CASE WHEN cs IS NULL THEN 0 WHEN strand > 0 THEN greatest(0, least(least(ee, ce), CASE WHEN ref = '' THEN p ELSE p - 1 END) - greatest(es, cs) + 1) ELSE greatest(0, least(ee, ce) - greatest(greatest(es, cs), q + 1) + 1) END AS o,
CASE WHEN cs IS NULL OR ref = '' THEN 0 ELSE greatest(0, least(least(ee, ce), q) - greatest(greatest(es, cs), p) + 1) END AS k, length(ref) > length(alt) AND CASE WHEN strand > 0 THEN ee <> te AND (ee + 1 BETWEEN p AND q OR ee + 2 BETWEEN p AND q OR ee + 5 BETWEEN p AND q) ELSE es <> ts AND (es - 1 BETWEEN p AND q OR es - 2 BETWEEN p AND q OR es - 5 BETWEEN p AND q) END AS td,
length(ref) > length(alt) AND CASE WHEN strand > 0 THEN es <> ts AND (es - 1 BETWEEN p AND q OR es - 2 BETWEEN p AND q) ELSE ee <> te AND (ee + 1 BETWEEN p AND q OR ee + 2 BETWEEN p AND q) END AS ta FROM n),
e AS (SELECT id, transcript, any_value(gene) AS gene, any_value(strand) AS strand, any_value(ts) AS ts, any_value(te) AS te, any_value(cs) AS cs, any_value(ce) AS ce, any_value(p) AS p, any_value(q) AS q, any_value(ref) AS ref, any_value(alt) AS alt, any_value(lps) AS lps, bool_or(p <= ee AND q >= es) AS ex, sum(o) AS o, sum(k) AS k, bool_or(td) AS td, bool_or(ta) AS ta, min(CASE WHEN strand > 0 THEN de ELSE ds END) AS donor, min(CASE WHEN strand > 0 THEN ds ELSE de END) AS acc FROM d GROUP BY ALL),
b AS (SELECT e.*, bases, (strand > 0 AND q < ts) OR (strand < 0 AND p > te) AS up, coalesce(q >= cs AND p <= ce, false) AS inc, length(ref) = 1 AND length(alt) = 1 AS single, length(alt) - CASE WHEN length(ref) > length(alt) THEN least(k, length(ref)) ELSE length(ref) END AS shift, CAST(o // 3 AS INT) AS codon, CAST(o % 3 AS INT) AS place, substring(bases, CAST(o // 3 * 3 + 1 AS INT), 3) AS rc, CASE WHEN strand > 0 THEN alt ELSE translate(reverse(alt), 'ACGT', 'TGCA') END AS base, CAST(ceil((o % 3 + length(ref)) / 3.0) * 3 AS INT) AS size FROM e LEFT JOIN q USING (transcript)),
a AS (SELECT *, substring(rc, 1, place) || base || substring(rc, place + 2, 3) AS ac, substring(bases, CAST(codon * 3 + 1 AS INT), size) AS win FROM b), g AS (SELECT *, NOT single AND inc AND ex AND shift % 3 = 0 AND k = length(ref) AND length(win) = size AS whole, substring(win, 1, place) || base || substring(win, CAST(place + length(ref) + 1 AS INT), size) AS aft FROM a),
y AS (SELECT *, CASE WHEN length(rc) < 3 THEN '' ELSE {_TRANSLATE.format('rc')} END AS old, CASE WHEN length(ac) < 3 THEN '' ELSE {_TRANSLATE.format('substring(ac, 1, 3)')} END AS new, CASE WHEN whole THEN {_residues('win')} END AS was, CASE WHEN whole THEN {_residues('aft')} END AS becomes FROM g),
h AS (SELECT *, CASE WHEN whole THEN CASE WHEN codon = 0 AND was LIKE 'M%' AND becomes NOT LIKE 'M%' AND becomes <> '' THEN 'start_lost' WHEN was NOT LIKE '%*' AND contains(becomes, '*') THEN 'stop_gained' WHEN was LIKE '%*' AND NOT contains(becomes, '*') AND becomes <> '' THEN 'stop_lost' END END AS edge FROM y),
z AS (SELECT *, list_filter([CASE WHEN up THEN 'upstream_gene' END, CASE WHEN td OR donor IN (1, 2, 5) OR (donor = 0 AND single AND ex) THEN 'splice_donor' END, CASE WHEN ta OR acc IN (1, 2) OR (acc = 3 AND base = 'G' AND single) THEN 'splice_acceptor' END,
CASE WHEN NOT ex THEN NULL WHEN cs IS NULL THEN 'non_coding_transcript' WHEN q < cs THEN CASE WHEN strand > 0 THEN 'five_prime_utr' ELSE 'three_prime_utr' END WHEN p > ce THEN CASE WHEN strand > 0 THEN 'three_prime_utr' ELSE 'five_prime_utr' END
WHEN inc AND single THEN CASE WHEN old = new THEN 'synonymous' WHEN codon = 0 AND old = 'M' THEN 'start_lost' WHEN new = '*' THEN 'stop_gained' WHEN old = '*' THEN 'stop_lost' ELSE 'missense' END WHEN inc THEN CASE WHEN shift % 3 <> 0 THEN 'frameshift' WHEN shift > 0 THEN 'inframe_insertion' WHEN shift < 0 THEN 'inframe_deletion' WHEN edge IS NOT NULL THEN NULL WHEN whole AND was = becomes THEN 'synonymous' ELSE 'missense' END END,
edge, CASE WHEN NOT ex AND NOT up THEN 'intronic' END], lambda s: s IS NOT NULL) AS effects FROM h)"""
_CODING = "CASE " + " ".join(f"WHEN list_has_any({{0}}, {some!r}) THEN '{name}'" for name, some in E.CODING_EFFECTS.items()) + " ELSE 'NONE' END"


def model(spark, sf_dir):
    """transcripts, exons, coding sequences, variants."""
    c = F.col
    s = c("s_suppkey")
    begin = 2000 * F.floor(s / 3)
    protein = lambda x: F.when(s % 5 != 0, (x + begin).cast("long"))
    t = table(spark, sf_dir, "supplier").select(s.alias("transcript"), F.floor(s / 2).alias("gene"), (s % 3).alias("chromosome"), F.when(s % 2 == 0, 1).otherwise(-1).alias("strand"), (1000 + begin).cast("long").alias("trans_start"), (1259 + begin).cast("long").alias("trans_end"), protein(1020).alias("coding_start"), protein(1240).alias("coding_end"))
    e = t.select("transcript", "trans_start", F.explode(F.array(F.lit(0), F.lit(100), F.lit(200))).alias("i")).select("transcript", (c("trans_start") + c("i")).alias("exon_start"), (c("trans_start") + c("i") + 59).alias("exon_end"))
    letters = F.array(*[F.lit(x) for x in "ACGTTGCAAG"])
    bases = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda i: F.get(letters, ((c("transcript") * 7 + i * i) % 10).cast("int"))), "")
    q = t.select("transcript", F.concat(F.lit("ATG"), bases).alias("bases"))
    n = c("l_linenumber")
    ref = F.when(n == 1, "").when(n == 2, "AC").when(n == 3, "ACG").otherwise(pick(BASES, c("l_partkey") % 4))
    alt = F.when(n == 1, "GG").when(n == 2, "").when(n == 3, "").otherwise(pick(BASES, (c("l_partkey") + 1 + c("l_orderkey") % 3) % 4))
    v = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", *[c(k).cast("string") for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), (c("l_suppkey") % 3).alias("chromosome"), (200 + 2000 * F.floor(c("l_suppkey") / 3) + (c("l_orderkey") * 13 + c("l_partkey") * 31 + n) % 1400).alias("position"), ref.alias("ref"), alt.alias("alt"), F.when(n % 2 == 0, c("l_suppkey") * 10 + c("l_orderkey") % 2).alias("lps"))
    return v.distinct(), t, e, q


@query(f"WITH {EFFECTS} SELECT id, transcript, array_to_string(effects, ';') AS effects, {_CODING.format('effects')} AS coding_effect, donor IS NOT NULL OR acc IS NOT NULL AS splice_region, CASE WHEN inc AND single AND ex THEN codon END AS codon, CASE WHEN inc AND single AND ex THEN ac END AS alt_codon FROM z")
def variant_effects(spark, sf_dir):
    return E.effects(*model(spark, sf_dir), 4096).select("id", "transcript", F.array_join("effects", ";").alias("effects"), "coding_effect", "splice_region", "codon", "alt_codon")


@query(f"""WITH {EFFECTS}, i AS (SELECT id, transcript, lps, CASE WHEN inc AND ex THEN shift END AS shift, CASE WHEN inc AND single AND ex THEN codon END AS codon, CASE WHEN inc AND single AND ex THEN rc END AS rc, CASE WHEN inc AND single AND ex THEN ac END AS ac FROM z),
w AS (SELECT *, sum(shift) FILTER (shift % 3 <> 0) OVER (PARTITION BY lps, transcript) AS total, count(*) FILTER (shift % 3 <> 0) OVER (PARTITION BY lps, transcript) AS many FROM i),
alts AS (SELECT DISTINCT lps, transcript, codon, k, substring(ac, CAST(k AS INT), 1) AS base FROM i, unnest([1, 2, 3]) AS u(k) WHERE lps IS NOT NULL AND codon IS NOT NULL AND substring(ac, CAST(k AS INT), 1) <> substring(rc, CAST(k AS INT), 1)),
places AS (SELECT lps, transcript, codon, k, count(*) AS kinds, any_value(base) AS base FROM alts GROUP BY ALL), codons AS (SELECT lps, transcript, codon, any_value(rc) AS rc FROM i WHERE codon IS NOT NULL GROUP BY ALL HAVING count(DISTINCT ac) > 1),
joint AS (SELECT c.lps, c.transcript, c.codon, c.rc, string_agg(coalesce(p.base, substring(c.rc, CAST(u.k AS INT), 1)), '' ORDER BY u.k) AS whole FROM codons c CROSS JOIN unnest([1, 2, 3]) AS u(k) LEFT JOIN places p ON p.lps = c.lps AND p.transcript = c.transcript AND p.codon = c.codon AND p.k = u.k GROUP BY ALL HAVING max(coalesce(p.kinds, 1)) = 1),
read AS (SELECT lps, transcript, codon, {_TRANSLATE.format('rc')} AS old, {_TRANSLATE.format('whole')} AS new FROM joint)
SELECT id, w.transcript, CASE WHEN w.lps IS NULL THEN NULL WHEN shift % 3 <> 0 AND many > 1 AND total % 3 = 0 THEN CASE WHEN total > 0 THEN 'phased_inframe_insertion' WHEN total < 0 THEN 'phased_inframe_deletion' ELSE 'phased_missense' END
WHEN old = new THEN 'phased_synonymous' WHEN old IS NOT NULL AND w.codon = 0 THEN 'start_lost' WHEN old = '*' THEN 'stop_lost' WHEN new = '*' THEN 'phased_missense;stop_gained' WHEN old IS NOT NULL THEN 'phased_missense' END AS phased FROM w LEFT JOIN read ON read.lps = w.lps AND read.transcript = w.transcript AND read.codon = w.codon""")
def phased_effects(spark, sf_dir):
    return E.phased(E.effects(*model(spark, sf_dir), 4096)).select("id", "transcript", "phased")


SIGNIFICANCE = ["Pathogenic", "Likely_pathogenic", "Pathogenic/Likely_pathogenic", "Benign", "Likely_benign", "Conflicting_interpretations", "Uncertain_significance"]
VOTES = ["Pathogenic(2)|Likely_pathogenic(1)", "Pathogenic(1)|Uncertain_significance(3)", "Likely_benign(1)|Pathogenic(1)"]


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, {SIGNIFICANCE!r}[1 + l_partkey % 7] AS s, CASE WHEN l_partkey % 7 = 5 THEN {VOTES!r}[1 + l_suppkey % 3] END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN contains(s, 'Conflicting') AND contains(coalesce(c, ''), 'athogenic') AND NOT contains(coalesce(c, ''), 'enign') AND NOT contains(coalesce(c, ''), 'Uncertain') THEN 'LIKELY_PATHOGENIC' WHEN contains(s, 'Conflicting') THEN 'CONFLICTING' WHEN contains(s, 'Pathogenic') THEN 'PATHOGENIC' WHEN contains(s, 'Likely_pathogenic') THEN 'LIKELY_PATHOGENIC' WHEN contains(s, 'Benign') THEN 'BENIGN' WHEN contains(s, 'Likely_benign') THEN 'LIKELY_BENIGN' ELSE 'UNKNOWN' END AS status FROM v""")
def clinical_significance(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pick(SIGNIFICANCE, c("l_partkey") % 7).alias("s"), F.when(c("l_partkey") % 7 == 5, pick(VOTES, c("l_suppkey") % 3)).alias("c"))
    return v.select("l_orderkey", "l_linenumber", E.pathogenicity(c("s"), c("c")).alias("status"))


KINDS = [*E.CODING_EFFECTS, "NONE"]


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey AS gene, {KINDS!r}[1 + l_linenumber % 5] AS e, l_suppkey % 7 = 0 AS h, l_orderkey % 9 AS r, l_linenumber % 2 = 0 AS i, l_returnflag <> 'R' AS pass FROM lineitem), g AS (SELECT p_partkey AS gene, CASE WHEN p_size % 2 = 0 THEN 'ONCO' ELSE 'TSG' END AS c, p_size % 3 > 0 AS m, p_size % 4 > 0 AS n, p_size % 5 > 0 AS s, p_size % 7 > 0 AS rh FROM part WHERE p_partkey % 3 > 0)
SELECT l_orderkey, l_linenumber, coalesce(pass AND ((h AND rh) OR (CASE e WHEN 'MISSENSE' THEN m WHEN 'NONSENSE_OR_FRAMESHIFT' THEN n WHEN 'SPLICE' THEN s ELSE false END AND NOT (c = 'ONCO' AND i AND r >= 4))), false) AS reported FROM v LEFT JOIN g USING (gene)""")
def reportable(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey").alias("gene"), pick(KINDS, c("l_linenumber") % 5).alias("coding_effect"), (c("l_suppkey") % 7 == 0).alias("hotspot"), (c("l_orderkey") % 9).alias("repeat_count"), (c("l_linenumber") % 2 == 0).alias("inframe"), F.when(c("l_returnflag") != "R", "PASS").otherwise("LOW").alias("filters"))
    n = c("p_size")
    g = table(spark, sf_dir, "part").filter("p_partkey % 3 > 0").select(c("p_partkey").alias("gene"), F.when(n % 2 == 0, "ONCO").otherwise("TSG").alias("category"), (n % 3 > 0).alias("missense"), (n % 4 > 0).alias("nonsense"), (n % 5 > 0).alias("splice"), (n % 7 > 0).alias("report_hotspot"))
    return E.reported(v, g).select("l_orderkey", "l_linenumber", "reported")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_discount * 9 AS af, 0.2 + l_tax * 8 AS p, 1.0 + l_linenumber AS cn, (l_partkey % 3)::DOUBLE AS mi FROM lineitem), d AS (SELECT *, cn - mi AS ma, 2 * (1 - p) + cn * p AS r FROM v), x AS (SELECT *, (1 - p + ma * p) / r - af AS g1, (1 - p + mi * p) / r - af AS g2, 1 - af AS g3, ma * p / r - af AS s1, mi * p / r - af AS s2, p / r - af AS s3 FROM d),
y AS (SELECT *, CASE WHEN abs(g1) < abs(g2) THEN g1 ELSE g2 END AS g, CASE WHEN abs(s1) < abs(s2) THEN s1 ELSE s2 END AS s FROM x) SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(g3) < abs(g) THEN g3 ELSE g END, 8) AS germline, round(CASE WHEN af < p / r THEN 0 WHEN abs(s3) < abs(s) THEN s3 ELSE s END, 8) AS somatic FROM y""")
def germline_distance(spark, sf_dir):
    c = F.col
    g, s = E.germline_likelihood(c("l_discount") * 9, 0.2 + c("l_tax") * 8, 1.0 + c("l_linenumber"), (c("l_partkey") % 3).cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(g, 8).alias("germline"), F.round(s, 8).alias("somatic"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_discount * 2 < 0.1 AND NOT (l_linenumber >= 3 AND l_quantity / 40 >= 0.5) AS a, l_quantity / 40 < 0.5 AND NOT l_partkey % 11 = 0 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN a AND b THEN 'LOW_VAF;LOW_TUMOR_VCN' WHEN a THEN 'LOW_VAF' WHEN b THEN 'LOW_TUMOR_VCN' ELSE 'PASS' END AS filters FROM v""")
def germline_filters(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") * 2).alias("vaf"), c("l_linenumber").alias("reads"), (c("l_quantity") / 40).alias("copies"), (c("l_partkey") % 11 == 0).alias("pathogenic"))
    return E.germline_filters(v).select("l_orderkey", "l_linenumber", "filters")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'R' AS pass, l_linenumber - 1 AS na, l_quantity AS nr, l_partkey % 30 AS ta, l_suppkey % 30 AS tr FROM lineitem) SELECT l_orderkey, l_linenumber, pass AND CASE WHEN ta + tr > 0 THEN ta / (ta + tr)::DOUBLE ELSE 0 END > 0 AND CASE WHEN na + nr > 0 THEN na / (na + nr) ELSE 0 END < (2.5 * 0.1 + 0.02) * CASE WHEN ta + tr > 0 THEN ta / (ta + tr)::DOUBLE ELSE 0 END AS somatic FROM v""")
def germline_sv_transfer(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(c("l_returnflag") != "R", "PASS").otherwise("LOW").alias("filters"), (c("l_linenumber") - 1).alias("normal_alt"), c("l_quantity").alias("normal_ref"), (c("l_partkey") % 30).alias("tumor_alt"), (c("l_suppkey") % 30).alias("tumor_ref"))
    return E.moved_by_contamination(v, 0.1).select("l_orderkey", "l_linenumber", "somatic")

"""Followed variants, hotspots and probes: items stand for variants, parts for hotspots, items of a part for a probe's alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracking as T
from ..storage import table
from .registry import query


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_discount / 5 AS gaf, l_partkey % 45 AS gq, l_suppkey % 9 = 0 AS ni, l_returnflag <> 'R' AS ok, l_partkey % 5 AS rc, l_suppkey % 6 AS arc, l_linenumber <> 3 AS snv, CASE WHEN l_partkey % 4 = 0 THEN 0.5 WHEN l_partkey % 4 = 1 THEN NULL ELSE 1.0 END AS m, l_suppkey % 13 = 0 AS lc, l_tax * 10 AS sub, l_quantity / 50 AS cn, l_discount * 8 AS gc, (l_orderkey % 4)::BIGINT AS ad, l_quantity * 2 AS qs, CASE WHEN l_partkey % 7 = 0 THEN -1 ELSE l_tax * 2 END AS ed FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN gaf >= 0.01 AND gq >= 30 THEN 'GERMLINE_AF' END, CASE WHEN ni THEN 'NEARBY_INDEL' END, CASE WHEN NOT ok THEN 'NO_PASS' END, CASE WHEN greatest(rc, arc) > 3 THEN 'REPEAT_COUNT' END, CASE WHEN NOT snv THEN 'NON_SNV' END, CASE WHEN m < 1 THEN 'MAPPABILITY' END, CASE WHEN lc THEN 'LOW_CONFIDENCE' END, CASE WHEN sub > 0.5 AND cn < 0.7 THEN 'SUBCLONAL' END, CASE WHEN gc < 0.4 THEN 'GC_RATIO' END,
CASE WHEN ad > 0 AND qs / ad <= 18 THEN 'LOW_QUAL_PER_AD' END, CASE WHEN ad > 0 AND ed >= 0 AND ed < 0.06 THEN 'AVG_EDGE_DIST' END], lambda x: x IS NOT NULL), ';') AS reasons FROM v""")
def tracked_variants(spark, sf_dir):
    c = F.col
    v = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_discount") / 5).alias("germline_af"), (c("l_partkey") % 45).alias("germline_quality"), (c("l_suppkey") % 9 == 0).alias("near_indel"), (c("l_returnflag") != "R").alias("passed"), (c("l_partkey") % 5).alias("repeat_count"), (c("l_suppkey") % 6).alias("alt_repeat_count"),
        (c("l_linenumber") != 3).alias("is_snv"), F.when(c("l_partkey") % 4 == 0, 0.5).when(c("l_partkey") % 4 == 1, None).otherwise(1.0).alias("mappability"), (c("l_suppkey") % 13 == 0).alias("low_confidence"), (c("l_tax") * 10).alias("subclonal"), (c("l_quantity") / 50).alias("copies"), (c("l_discount") * 8).alias("gc"),
        (c("l_orderkey") % 4).alias("allele_fragments"), (c("l_quantity") * 2).alias("quality_sum"), F.when(c("l_partkey") % 7 == 0, -1).otherwise(c("l_tax") * 2).alias("edge_distance"),
    )
    return T.tracked_filters(v, 0.4).select("l_orderkey", "l_linenumber", F.array_join("reasons", ";").alias("reasons"))


_HOTSPOTS = "h AS (SELECT p_partkey % 5 AS c, p_partkey * 7 AS p, CASE WHEN p_partkey % 3 = 0 THEN 'AC' ELSE 'A' END AS r, CASE WHEN p_partkey % 2 = 0 THEN 'G' ELSE 'T' END AS a FROM part)"


@query(f"""WITH {_HOTSPOTS}, v AS (SELECT DISTINCT concat_ws('-', l_suppkey % 5, l_partkey * 7 + l_linenumber - 1, CASE WHEN l_orderkey % 3 = 0 THEN 'AC' ELSE 'A' END, CASE WHEN l_orderkey % 2 = 0 THEN 'G' ELSE 'T' END) AS id, l_suppkey % 5 AS c, l_partkey * 7 + l_linenumber - 1 AS p, CASE WHEN l_orderkey % 3 = 0 THEN 'AC' ELSE 'A' END AS r, CASE WHEN l_orderkey % 2 = 0 THEN 'G' ELSE 'T' END AS a FROM lineitem),
m AS (SELECT v.id, bool_or(v.p = h.p AND v.r = h.r AND v.a = h.a) AS same FROM v JOIN h ON v.c = h.c AND v.p <= h.p + length(h.r) + 4 AND h.p <= v.p + length(v.r) + 4 GROUP BY 1) SELECT id, CASE WHEN same THEN 'HOTSPOT' WHEN same IS NOT NULL THEN 'NEAR_HOTSPOT' ELSE 'NONE' END AS hotspot FROM v LEFT JOIN m USING (id)""")
def hotspots(spark, sf_dir):
    c = F.col
    h = table(spark, sf_dir, "part").select((c("p_partkey") % 5).alias("chromosome"), (c("p_partkey") * 7).alias("position"), F.when(c("p_partkey") % 3 == 0, "AC").otherwise("A").alias("ref"), F.when(c("p_partkey") % 2 == 0, "G").otherwise("T").alias("alt"))
    v = table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 5).alias("chromosome"), (c("l_partkey") * 7 + c("l_linenumber") - 1).alias("position"), F.when(c("l_orderkey") % 3 == 0, "AC").otherwise("A").alias("ref"), F.when(c("l_orderkey") % 2 == 0, "G").otherwise("T").alias("alt")).distinct()
    return T.hotspot_flags(v.withColumn("id", F.concat_ws("-", c("chromosome").cast("string"), c("position").cast("string"), "ref", "alt")), h)


@query("""WITH a AS (SELECT l_partkey AS probe, CAST(l_quantity AS BIGINT) + 20 AS s, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS k FROM lineitem), t AS (SELECT probe, max(s) AS t, count(*) FILTER (k > 1 AND s >= 40) AS n, coalesce(sum(s) FILTER (k > 1 AND s >= 40), 0) AS u FROM a GROUP BY 1)
SELECT probe, round(1 / (1 + (u - n * 30) / nullif(t - 30, 0)::DOUBLE), 8) AS quality, (u - n * 30)::BIGINT AS risk, n AS off_targets, u::BIGINT AS score_sum FROM t""")
def probe_quality(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("probe"), (F.col("l_quantity").cast("long") + 20).alias("score"))
    return T.probe_quality(a, 40, 10).withColumn("quality", F.round("quality", 8))

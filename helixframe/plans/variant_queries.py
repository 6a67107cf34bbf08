"""Variant queries: a line item stands for a variant (quantity: evidence, discount: allele frequency, return flag: tier), its supplier for the sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import variants as V
from ..storage import table
from .registry import query


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


OLD_NEW = """old AS (SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_extendedprice AS price, l_returnflag AS flag FROM lineitem WHERE l_orderkey % 10 <> 3),
new AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN l_quantity + 2 ELSE l_quantity END AS qty, CASE WHEN l_orderkey % 5 = 0 THEN l_extendedprice * 1.06 ELSE l_extendedprice END AS price,
  CASE WHEN l_linenumber = 4 THEN 'N' ELSE l_returnflag END AS flag FROM lineitem WHERE l_orderkey % 10 <> 4),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY qty, price, flag) AS n FROM old), w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY qty, price, flag) AS n FROM new)"""


@query(f"""WITH {OLD_NEW}, j AS (SELECT coalesce(o.l_orderkey, w.l_orderkey) AS l_orderkey, coalesce(o.l_linenumber, w.l_linenumber) AS l_linenumber, o.n AS a, w.n AS b,
  concat_ws(';', CASE WHEN abs(o.qty - w.qty) > 1 THEN 'qty' END, CASE WHEN abs(o.price - w.price) > 0.5 AND abs(o.price - w.price) / greatest(abs(o.price), abs(w.price)) > 0.05 THEN 'price' END, CASE WHEN o.flag <> w.flag THEN 'flag' END) AS f
  FROM o FULL JOIN w ON o.l_orderkey = w.l_orderkey AND o.l_linenumber = w.l_linenumber AND o.n = w.n)
SELECT l_orderkey, l_linenumber, CASE WHEN b IS NULL THEN 'OLD_ONLY' WHEN a IS NULL THEN 'NEW_ONLY' ELSE 'VALUE' END AS mismatch, CASE WHEN a IS NULL OR b IS NULL THEN '' ELSE f END AS fields FROM j WHERE a IS NULL OR b IS NULL OR f <> ''""")
def diff_two_sources(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    old = rows.filter("l_orderkey % 10 != 3")
    new = rows.filter("l_orderkey % 10 != 4").withColumns({"qty": F.when(F.col("l_orderkey") % 7 == 0, F.col("qty") + 2).otherwise(F.col("qty")), "price": F.when(F.col("l_orderkey") % 5 == 0, F.col("price") * 1.06).otherwise(F.col("price")), "flag": F.when(F.col("l_linenumber") == 4, "N").otherwise(F.col("flag"))})
    return D.compared(old, new, ["l_orderkey", "l_linenumber"], [D.Field("qty", 1.0), D.Field("price", 0.5, 0.05), D.Field("flag")])


@query("""SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) > 10 AS far, CASE WHEN l_discount = 0 AND l_tax = 0 THEN false ELSE abs(l_discount - l_tax) > 0.02 AND abs(l_discount - l_tax) / greatest(l_discount, l_tax) > 0.5 END AS both FROM lineitem""")
def threshold_diff(spark, sf_dir):
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", D.differs(F.col("l_quantity"), F.lit(25.0), 10).alias("far"), D.differs(F.col("l_discount"), F.col("l_tax"), 0.02, 0.5).alias("both"))


PON = "p AS (SELECT l_partkey, l_linenumber, count(DISTINCT l_suppkey) AS samples, max(l_quantity) AS max_reads, sum(l_quantity) AS total_reads FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 2)"


def panel(spark, sf_dir):
    return V.pon(items(spark, sf_dir).filter("l_returnflag != 'R'"), ["l_partkey", "l_linenumber"], "l_suppkey", "l_quantity", 2)


@query(f"WITH {PON} SELECT * FROM p")
def pon_build(spark, sf_dir):
    return panel(spark, sf_dir)


@query(f"WITH {PON} SELECT l_partkey, l_linenumber, sum(samples)::BIGINT AS samples, max(max_reads) AS max_reads, sum(total_reads) AS total_reads FROM (SELECT * FROM p UNION ALL SELECT l_partkey, l_linenumber, 1, max(l_quantity), sum(l_quantity) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY ALL")
def pon_combine(spark, sf_dir):
    other = V.pon(items(spark, sf_dir).filter("l_returnflag = 'R'"), ["l_partkey", "l_linenumber"], "l_suppkey", "l_quantity").withColumn("samples", F.lit(1).cast("long"))
    return V.pon_combined([panel(spark, sf_dir), other], ["l_partkey", "l_linenumber"])


@query(f"""WITH {PON}, t(tier, s, r) AS (VALUES ('A', 2, 30.0), ('N', 3, 40.0), ('UNKNOWN', 4, 45.0))
SELECT l_orderkey, l.l_linenumber, samples, coalesce(samples >= s AND max_reads >= r, false) AS pon FROM lineitem l LEFT JOIN p ON l.l_partkey = p.l_partkey AND l.l_linenumber = p.l_linenumber JOIN t ON t.tier = CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag ELSE 'UNKNOWN' END""")
def pon_filter(spark, sf_dir):
    tiers = spark.createDataFrame([("A", 2, 30.0), ("N", 3, 40.0), ("UNKNOWN", 4, 45.0)], "tier string, min_samples int, min_reads double")
    rows = items(spark, sf_dir).withColumn("tier", F.col("l_returnflag"))
    return V.pon_filtered(rows, panel(spark, sf_dir), ["l_partkey", "l_linenumber"], tiers).select("l_orderkey", "l_linenumber", "samples", "pon")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN f = '' THEN 'PASS' ELSE f END AS filters FROM (SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_quantity < 10 THEN 'minTumorQual' END,
  CASE WHEN l_discount < 0.02 THEN 'minTumorVAF' END, CASE WHEN l_tax > 0.06 THEN 'maxGermlineVAF' END, CASE WHEN l_linestatus = 'F' AND l_extendedprice < 20000 THEN 'strandBias' END) AS f FROM lineitem)""")
def soft_filter_set(spark, sf_dir):
    tests = {"minTumorQual": F.col("l_quantity") < 10, "minTumorVAF": F.col("l_discount") < 0.02, "maxGermlineVAF": F.col("l_tax") > 0.06, "strandBias": (F.col("l_linestatus") == "F") & (F.col("l_extendedprice") < 20000)}
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", V.filter_names(tests).alias("filters"))


@query("""SELECT coalesce(CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_quantity < 4 THEN 'altSupport' WHEN l_extendedprice < 9000 THEN 'tumorQual' WHEN l_discount < 0.01 THEN 'tumorVaf' END, 'PASS') AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def hard_filter_counts(spark, sf_dir):
    reason = V.first_failure({"altSupport": F.col("l_quantity") < 4, "tumorQual": F.col("l_extendedprice") < 9000, "tumorVaf": F.col("l_discount") < 0.01})
    return items(spark, sf_dir).select(F.coalesce(F.when(F.col("l_returnflag") != "A", reason), F.lit("PASS")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def semi_panel(spark, sf_dir):
    return items(spark, sf_dir).join(table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l.l_partkey AND p_size >= 10)")
def anti_blacklist(spark, sf_dir):
    return items(spark, sf_dir).join(table(spark, sf_dir, "part").filter("p_size >= 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem),
s AS (SELECT l_partkey, l_suppkey, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey, l_quantity, l_orderkey, l_linenumber, flags FROM b JOIN s USING (l_partkey, l_suppkey) WHERE n = 1""")
def dedup_best(spark, sf_dir):
    out = V.deduplicated(items(spark, sf_dir), ["l_partkey", "l_suppkey"], "l_quantity", "l_returnflag", "l_orderkey", "l_linenumber")
    return out.withColumn("flags", F.array_join("l_returnflag", ";")).drop("l_returnflag")


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def top_k(spark, sf_dir):
    return V.top_per(items(spark, sf_dir), ["l_suppkey"], 3, F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_partkey, l_suppkey) GROUP BY 1")
def dup_groups(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY abs(2 - l_quantity / 10), l_extendedprice, l_orderkey, l_linenumber) = 1")
def most_diploid_per_purity(spark, sf_dir):
    return V.best_per(items(spark, sf_dir), ["l_suppkey"], F.abs(2 - F.col("l_quantity") / 10), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS n, count(*) OVER () AS t FROM orders)
SELECT o_orderkey FROM r WHERE (n - 1) % CAST(ceil(t / 1000.0) AS BIGINT) = 0""")
def downsample_every_k(spark, sf_dir):
    return V.every_nth(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 1000).select("o_orderkey")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity, 2 * l_orderkey AS s, 2 * l_partkey + 1 AS t FROM lineitem), e AS (SELECT DISTINCT unnest([s, t]) AS x FROM g WHERE l_quantity >= 50)
SELECT l_orderkey, l_linenumber FROM g WHERE l_quantity >= 50 OR s IN (SELECT x FROM e) OR t IN (SELECT x FROM e)""")
def phase_set_rescue(spark, sf_dir):
    """An order and a part are phase sets of their items: some of them have a passing row, and all of them count."""
    sets = F.array(2 * F.col("l_orderkey"), 2 * F.col("l_partkey") + 1)
    rows = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", sets.alias("sets"))
    return V.rescued(rows, "sets", F.col("l_quantity") >= 50).select("l_orderkey", "l_linenumber")


_A, _B = "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 20", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.05"


def _two(spark, sf_dir):
    a = items(spark, sf_dir).filter("l_quantity < 20").select("l_partkey", "l_suppkey")
    return a, items(spark, sf_dir).filter("l_discount > 0.05").select("l_partkey", "l_suppkey")


@query(f"{_A} UNION {_B}")
def set_union(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.union(b).distinct()


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.intersect(b)


@query(f"{_A} EXCEPT ALL {_B}")
def set_except(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.exceptAll(b)


@query("SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 7")
def intersect_all_samples(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_partkey").agg(F.count_distinct("l_linenumber").alias("n")).filter("n = 7").drop("n")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b ON a.k = b.k""")
def cache_precedence(spark, sf_dir):
    part = lambda n: items(spark, sf_dir).filter(F.col("l_linenumber") == n).groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").alias("v"))
    return part(1).alias("a").join(part(2).withColumnRenamed("v", "w").alias("b"), "k", "full_outer").select("k", F.coalesce("v", "w").alias("v"))


@query("""WITH m AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS bin, n_name AS chromosome, count(*) AS n FROM m JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def lookup_star(spark, sf_dir):
    m = items(spark, sf_dir).select("l_partkey", "l_suppkey").distinct()
    part, supplier, nation = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    joined = m.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "mid").otherwise("large")
    return joined.groupBy(size.alias("bin"), F.col("n_name").alias("chromosome")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN k = 23 THEN 'X' WHEN k = 24 THEN 'Y' WHEN k = 25 THEN 'MT' ELSE k::VARCHAR END AS contig, k::INT AS rank FROM (SELECT o_orderkey, 1 + o_custkey % 25 AS k FROM orders)")
def genome_order(spark, sf_dir):
    k = F.col("o_custkey") % 25 + 1
    contig = F.when(k == 23, "X").when(k == 24, "Y").when(k == 25, "MT").otherwise(k.cast("string"))
    out = table(spark, sf_dir, "orders").select("o_orderkey", contig.alias("contig"))
    return out.withColumn("rank", V.contig_rank(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "chr").otherwise(""), F.col("contig")))).orderBy("rank", "o_orderkey")



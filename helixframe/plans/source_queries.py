"""Readers and writers: each query writes the driver's tables in a format of the field into the shared folder, reads them again, and returns what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..sources import bam as B
from ..sources import readers as R
from ..sources import writers as W
from ..storage import scratch_path, table
from .registry import days, query
from .sv_queries import pick

DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


def text(spark, lines, what: str) -> str:
    """Lines of text, a column each row, as files; the path."""
    path = scratch_path(spark, what)
    lines.write.text(path)
    return path


def tabbed(*cells):
    return F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value")


VARIANTS = "v AS (SELECT 'chr' || (1 + l_suppkey % 22) AS chromosome, l_partkey AS position, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'AC' END AS ref, CASE WHEN l_linenumber % 3 = 0 THEN 'G,T' ELSE 'G' END AS alts, l_quantity AS qual, CASE WHEN l_returnflag = 'R' THEN 'lowq;strand' ELSE '' END AS filters, CAST(l_quantity AS BIGINT)::VARCHAR AS dp, l_linenumber % 4 = 0 AS somatic, l_suppkey || ',' || l_linenumber AS ad FROM lineitem)"


def variant_lines(spark, sf_dir):
    c = F.col
    n = c("l_linenumber")
    info = F.concat(F.lit("DP="), c("l_quantity").cast("long").cast("string"), F.when(n % 4 == 0, ";SOMATIC").otherwise(""))
    row = tabbed(F.concat(F.lit("chr"), (1 + c("l_suppkey") % 22).cast("string")), c("l_partkey"), F.lit("."), F.when(n % 2 == 0, "A").otherwise("AC"), F.when(n % 3 == 0, "G,T").otherwise("G"), c("l_quantity"), F.when(c("l_returnflag") == "R", "lowq;strand").otherwise("PASS"), info, F.lit("GT:AD"), F.concat(F.lit("0/1:"), c("l_suppkey").cast("string"), F.lit(","), n.cast("string")))
    return text(spark, table(spark, sf_dir, "lineitem").select(row), "vcf")


def variant_columns(rows):
    return rows.select("chromosome", "position", "ref", F.array_join("alts", ",").alias("alts"), "qual", F.array_join(F.array_sort("filters"), ";").alias("filters"), F.col("info")["DP"].alias("dp"), F.col("info")["SOMATIC"].isNotNull().alias("somatic"), F.get("genotypes", F.lit(0))["AD"].alias("ad"))


@query(f"WITH {VARIANTS} SELECT * FROM v")
def vcf_source(spark, sf_dir):
    return variant_columns(R.variants(spark, variant_lines(spark, sf_dir)))


@query(f"WITH {VARIANTS} SELECT * FROM v")
def vcf_sink(spark, sf_dir):
    """Written in genome order by the writer, and read again."""
    path = scratch_path(spark, "vcf-out")
    W.variants(R.variants(spark, variant_lines(spark, sf_dir)), path, ["S"], 4)
    return variant_columns(R.variants(spark, path))


READS = "r AS (SELECT 'r' || l_orderkey AS name, (l_linenumber * 64 + CASE WHEN l_partkey % 9 = 0 THEN 1024 ELSE 0 END)::INT AS flags, 'c' || l_suppkey % 5 AS chromosome, l_partkey AS position, (l_quantity)::INT AS mapq, 5 + l_linenumber AS m, l_suppkey % 3 AS d, l_orderkey % 4 AS s FROM lineitem)"


def read_lines(spark, sf_dir):
    c = F.col
    n = c("l_linenumber")
    part = lambda k, o: F.when(k > 0, F.concat(k.cast("string"), F.lit(o))).otherwise("")
    cigar = F.concat(part(c("l_orderkey") % 4, "S"), part(5 + n, "M"), part(c("l_suppkey") % 3, "D"), F.lit("7M"))
    size = (c("l_orderkey") % 4 + 12 + n).cast("int")
    flags = n * 64 + F.when(c("l_partkey") % 9 == 0, 1024).otherwise(0)
    row = tabbed(F.concat(F.lit("r"), c("l_orderkey").cast("string")), flags, F.concat(F.lit("c"), (c("l_suppkey") % 5).cast("string")), c("l_partkey"), c("l_quantity").cast("int"), cigar, F.lit("="), c("l_partkey") + 200, F.lit(300), F.repeat(F.lit("A"), size), F.repeat(F.lit("I"), size), F.concat(F.lit("NM:i:"), n.cast("string")))
    return text(spark, table(spark, sf_dir, "lineitem").select(row), "sam")


@query(f"WITH {READS} SELECT name, flags, chromosome, position, mapq, (position + m + d + 6)::BIGINT AS \"end\", position + 200 AS mate FROM r WHERE mapq >= 10 AND flags & 1024 = 0 AND EXISTS (SELECT 1 FROM unnest([100, 900]) AS u(a) WHERE chromosome <> 'c4' AND position <= a + 400 AND position + m + d + 6 >= a)")
def sam_source(spark, sf_dir):
    """A region scan: reads of good quality, no duplicates, that overlap two regions of four chromosomes."""
    regions = spark.createDataFrame([(f"c{i}", a, a + 400) for i in range(4) for a in (100, 900)], "chromosome string, start long, end long")
    rows = R.alignments(spark, read_lines(spark, sf_dir), regions, least_quality=10, duplicates=False)
    return rows.select("name", "flags", "chromosome", "position", "mapq", "end", F.col("mate_position").alias("mate"))


@query(f"WITH {READS} SELECT chromosome, count(*) AS n, sum(position)::BIGINT AS total, sum(m + d + s)::BIGINT AS sizes FROM r GROUP BY 1")
def sam_sink(spark, sf_dir):
    path = scratch_path(spark, "sam-out")
    W.alignments(R.alignments(spark, read_lines(spark, sf_dir)).withColumn("tags", F.map_filter("tags", lambda k, v: k != "NM")), path, 4)
    rows = R.alignments(spark, path)
    soft = F.coalesce(F.regexp_extract("cigar", "^([0-9]+)S", 1).try_cast("long"), F.lit(0))
    return rows.groupBy("chromosome").agg(F.count("*").alias("n"), F.sum("position").alias("total"), F.sum(F.col("end") - F.col("position") - 6 + soft).alias("sizes"))


CONTIGS = [(f"c{i}", 1 << 28) for i in range(5)]


@query(f"WITH {READS} SELECT name, flags, chromosome, position, mapq, (position + m + d + 6)::BIGINT AS \"end\", position + 200 AS mate, CASE WHEN s > 0 THEN s || 'S' ELSE '' END || m || 'M' || CASE WHEN d > 0 THEN d || 'D' ELSE '' END || '7M' AS cigar, (m + 7 + s)::INT AS bases, (m - 5)::VARCHAR AS nm FROM r WHERE mapq >= 10 AND flags & 1024 = 0 AND EXISTS (SELECT 1 FROM unnest([100, 900]) AS u(a) WHERE chromosome <> 'c4' AND position <= a + 400 AND position + m + d + 6 >= a)")
def bam_source(spark, sf_dir):
    """The reads of ``sam_source`` as binary files with indexes, scanned by region; partitions are small, so that files are cut at offsets of their indexes."""
    path = scratch_path(spark, "bam")
    B.written(R.alignments(spark, read_lines(spark, sf_dir)), path, CONTIGS, 4)
    rows = B.alignments(spark, path, [(f"c{i}", a, a + 400) for i in range(4) for a in (100, 900)], least_quality=10, duplicates=False, split=1 << 16)
    return rows.select("name", "flags", "chromosome", "position", "mapq", "end", F.col("mate_position").alias("mate"), "cigar", F.length("bases").alias("bases"), F.col("tags")["NM"].alias("nm"))


@query(f"WITH {READS} SELECT chromosome, count(*) AS n, sum(position)::BIGINT AS total, sum(m + d + s)::BIGINT AS sizes, count(DISTINCT name) AS names FROM r GROUP BY 1")
def bam_sink(spark, sf_dir):
    """All reads written as binary files and read again, whole."""
    path = scratch_path(spark, "bam")
    B.written(R.alignments(spark, read_lines(spark, sf_dir)), path, CONTIGS, 4)
    rows = B.alignments(spark, path, split=1 << 16)
    soft = F.coalesce(F.regexp_extract("cigar", "^([0-9]+)S", 1).try_cast("long"), F.lit(0))
    return rows.groupBy("chromosome").agg(F.count("*").alias("n"), F.sum("position").alias("total"), F.sum(F.col("end") - F.col("position") - 6 + soft).alias("sizes"), F.countDistinct("name").alias("names"))


@query("""WITH r AS (SELECT 'q' || l_orderkey || '_' || l_linenumber AS name, repeat('ACGT', 2 + l_linenumber) AS bases, (CASE WHEN l_partkey % 3 = 0 THEN '@' WHEN l_partkey % 3 = 1 THEN '+' ELSE 'I' END) || repeat('F', 4 * (2 + l_linenumber) - 1) AS quals FROM lineitem) SELECT name || '_' || substring(bases, 1, 3) AS name, substring(bases, 4) AS bases, substring(quals, 4) AS qualities FROM r""")
def fastq_source(spark, sf_dir):
    """A third of the quality lines begin with the sign that names begin with. The first bases go into the name."""
    c = F.col
    size = (2 + c("l_linenumber")).cast("int")
    quality = F.concat(pick(["@", "+", "I"], c("l_partkey") % 3), F.repeat(F.lit("F"), 4 * size - 1))
    name = F.concat(F.lit("@q"), c("l_orderkey").cast("string"), F.lit("_"), c("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("\n", name, F.repeat(F.lit("ACGT"), size), F.lit("+"), quality).alias("value"))
    return R.reads_of(spark, text(spark, lines, "fastq"), 3)


SEQ = "s AS (SELECT s_suppkey AS k, repeat('ACGTTGCA', CAST(20 + s_suppkey % 40 AS INT)) || repeat('N', CAST(s_suppkey % 7 AS INT)) AS b FROM supplier)"


def contigs(spark, sf_dir):
    k = F.col("s_suppkey")
    bases = F.concat(F.repeat(F.lit("ACGTTGCA"), (20 + k % 40).cast("int")), F.repeat(F.lit("N"), (k % 7).cast("int")))
    wrapped = F.regexp_replace(bases, "(.{60})", "$1\n")
    lines = table(spark, sf_dir, "supplier").select(F.concat(F.lit(">c"), k.cast("string"), F.lit(" a contig\n"), wrapped).alias("value"))
    return R.sequences(spark, text(spark, lines, "fasta"), 100)


@query(f"WITH {SEQ} SELECT 'c' || k AS contig, i::INT AS chunk, substring(b, CAST(i * 100 + 1 AS INT), 100) AS bases FROM s, unnest(generate_series(0, 10)) AS u(i) WHERE i * 100 < length(b)")
def fasta_source(spark, sf_dir):
    return contigs(spark, sf_dir)


@query(f"WITH {SEQ} SELECT 'c' || k AS contig, k % 90 + 1 AS start, k % 90 + 70 AS \"end\", substring(b, CAST(k % 90 + 1 AS INT), 70) AS bases FROM s")
def fasta_lookup(spark, sf_dir):
    k = F.col("s_suppkey")
    regions = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), k.cast("string")).alias("contig"), (k % 90 + 1).alias("start"), (k % 90 + 70).alias("end"))
    return R.base_string(contigs(spark, sf_dir), regions, 100)


@query(f"SELECT o_custkey::VARCHAR AS chromosome, {DAY.format('o_orderdate')} + 1 AS start, {DAY.format('o_orderdate')} + 50 AS \"end\", o_orderpriority AS name FROM orders")
def bed_source(spark, sf_dir):
    d = days("o_orderdate")
    return R.bed(spark, text(spark, table(spark, sf_dir, "orders").select(tabbed(F.col("o_custkey"), d, d + 50, F.col("o_orderpriority"))), "bed"))


@query(f"SELECT o_custkey::VARCHAR AS chromosome, {DAY.format('o_orderdate')} AS start, {DAY.format('o_orderdate')} + 9 AS \"end\", round(o_totalprice, 2) AS mean FROM orders")
def segment_files(spark, sf_dir):
    """Written by the segment sink, read by the segment scan."""
    path = scratch_path(spark, "segments")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("chromosome"), days("o_orderdate").alias("start"), (days("o_orderdate") + 9).alias("end"), F.round("o_totalprice", 2).alias("mean"))
    W.segments(o, path)
    return R.segments(spark, path)


@query("SELECT 'c' || l_suppkey % 3 AS chromosome, l_partkey * 1000 + 1 AS start, l_partkey * 1000 + 1000 AS \"end\", round(l_discount * 10, 4) AS gc, 1.0::DOUBLE AS non_n, round(1 - l_tax * 4, 4) AS mappable, round(1 - l_tax * 4, 4) >= 0.85 AS is_mappable FROM lineitem")
def gc_profile_source(spark, sf_dir):
    c = F.col
    lines = table(spark, sf_dir, "lineitem").select(tabbed(F.concat(F.lit("c"), (c("l_suppkey") % 3).cast("string")), c("l_partkey") * 1000, F.round(c("l_discount") * 10, 4), F.lit(1), F.round(1 - c("l_tax") * 4, 4)))
    return R.gc_profile(spark, text(spark, lines, "gc"))


@query("SELECT s_suppkey::VARCHAR AS gene, column_, value FROM (SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (value FOR column_ IN (nation, balance))")
def matrix_source(spark, sf_dir):
    path = scratch_path(spark, "matrix")
    W.delimited(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")), path)
    return R.matrix(spark, path, "gene").withColumnRenamed("column", "column_")


@query("SELECT c_custkey, c_acctbal, NULL::VARCHAR AS missing, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS segment FROM customer")
def delimited_files(spark, sf_dir):
    """By column name, in another order, with a column that the file lacks."""
    path = scratch_path(spark, "delimited")
    c = table(spark, sf_dir, "customer").select("c_acctbal", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("segment"), "c_custkey")
    W.delimited(c, path, ["segment", "c_custkey", "c_acctbal"])
    return R.delimited(spark, path, "c_custkey long, c_acctbal double, missing string, segment string")


@query(f"SELECT o_custkey::VARCHAR AS chromosome, {DAY.format('o_orderdate')} AS position, -1.0::DOUBLE AS reference_depth, round(o_totalprice, 2) AS tumor_depth, -1.0::DOUBLE AS tumor_gc FROM orders")
def ratio_sink(spark, sf_dir):
    path = scratch_path(spark, "ratios")
    W.ratios(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chromosome"), days("o_orderdate").alias("position"), F.round("o_totalprice", 2).alias("tumorReadDepth")), path)
    rows = R.delimited(spark, path, "chromosome string, position long, referenceReadDepth double, tumorReadDepth double, tumorGCRatio double")
    return rows.withColumnsRenamed({"referenceReadDepth": "reference_depth", "tumorReadDepth": "tumor_depth", "tumorGCRatio": "tumor_gc"})


@query("SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def json_documents(spark, sf_dir):
    """Reports by customer as JSON records, written and read with a schema."""
    o = table(spark, sf_dir, "orders")
    path = text(spark, W.report(o, {"orders": o.select("o_custkey", "o_orderkey", "o_totalprice")}, "o_custkey").select(F.concat(F.lit('{"o_custkey":'), F.col("o_custkey").cast("string"), F.lit(',"report":'), "report", F.lit("}")).alias("value")), "json")
    rows = R.documents(spark, path, "o_custkey long, report struct<orders: array<struct<o_orderkey: long, o_totalprice: double>>>")
    total = F.aggregate("report.orders", F.lit(0.0), lambda s, x: s + x["o_totalprice"])
    return rows.select("o_custkey", F.size("report.orders").cast("long").alias("orders"), F.round(total, 2).alias("total"))


@query("SELECT p_brand AS chromosome, p_partkey AS start, p_partkey + p_size AS \"end\", '+' AS strand, p_name AS gene_id, 'basic,' || p_type AS tags FROM part")
def gtf_source(spark, sf_dir):
    c = F.col
    attributes = F.concat(F.lit('gene_id "'), c("p_name"), F.lit('"; tag "basic"; tag "'), c("p_type"), F.lit('";'))
    lines = table(spark, sf_dir, "part").select(tabbed(c("p_brand"), F.lit("src"), F.lit("gene"), c("p_partkey"), c("p_partkey") + c("p_size"), F.lit("."), F.lit("+"), F.lit("."), attributes))
    rows = R.features(spark, text(spark, lines, "gtf"))
    return rows.select("chromosome", "start", "end", "strand", c("attributes")["gene_id"].alias("gene_id"), F.array_join(c("every")["tag"], ",").alias("tags"))


@query("SELECT 'mapped ' || l_returnflag AS label, count(*) AS passed, count(*) FILTER (l_linenumber = 7) AS failed FROM lineitem GROUP BY 1")
def flagstat_source(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("p"), F.count_if(F.col("l_linenumber") == 7).alias("f"))
    line = F.concat(F.col("p").cast("string"), F.lit(" + "), F.col("f").cast("string"), F.lit(" mapped "), "l_returnflag", F.lit(" (99.00% : N/A)"))
    return R.flagstat(spark, text(spark, g.select(line.alias("value")), "flagstat"))


@query("SELECT p_partkey::VARCHAR AS gene_id, p_name AS gene_name, p_brand AS chromosome, count(*) AS exons, min(p_size + i * 100)::BIGINT AS first, 'D' || p_size AS domain FROM part, unnest([0, 1, 2]) AS u(i) GROUP BY ALL")
def gene_cache_source(spark, sf_dir):
    c = F.col
    folder = scratch_path(spark, "genes")
    p = table(spark, sf_dir, "part")
    id_ = c("p_partkey").cast("string")
    write = lambda rows, name: W.delimited(rows, f"{folder}/{name}", separator=",", compression=None)
    write(p.select(id_.alias("GeneId"), c("p_name").alias("GeneName"), c("p_brand").alias("Chromosome"), F.lit(1).alias("Strand"), c("p_size").alias("GeneStart"), (c("p_size") + 300).alias("GeneEnd")), "ensembl_gene_data.csv")
    e = p.select(id_.alias("GeneId"), c("p_partkey").cast("int").alias("TransId"), "p_size", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("ExonRank"))
    write(e.select("GeneId", "TransId", "ExonRank", (c("p_size") + c("ExonRank") * 100).alias("ExonStart"), (c("p_size") + c("ExonRank") * 100 + 50).alias("ExonEnd")), "ensembl_trans_exon_data.csv")
    write(p.select(c("p_partkey").cast("int").alias("TranscriptId"), F.lit(1).alias("TranslationId"), F.concat(F.lit("D"), c("p_size").cast("string")).alias("ProteinFeatureId"), F.lit(1).alias("SeqStart"), F.lit(9).alias("SeqEnd"), F.lit("x").alias("HitDescription")), "ensembl_protein_features.csv")
    found = R.gene_cache(spark, folder)
    exons = found["exons"].groupBy("GeneId", "TransId").agg(F.count("*").alias("exons"), F.min("ExonStart").alias("first")).join(found["protein_features"].withColumnRenamed("TranscriptId", "TransId"), "TransId")
    return found["genes"].join(exons, "GeneId").select(c("GeneId").alias("gene_id"), c("GeneName").alias("gene_name"), c("Chromosome").alias("chromosome"), "exons", "first", c("ProteinFeatureId").alias("domain"))


@query("SELECT l_partkey AS locus, l_linestatus AS population, l_orderkey AS allele, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_partkey, l_linestatus), 8) AS frequency FROM lineitem")
def allele_frequencies(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("locus"), c("l_linestatus").alias("population"), c("l_orderkey").alias("allele"), c("l_quantity").alias("frequency"))
    return R.normalised_frequencies(rows, "locus", "population", "frequency").select("locus", "population", "allele", F.round("frequency", 8).alias("frequency"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def jdbc_round_trip(spark, sf_dir):
    """Inserted in batches into an embedded database, which is in the driver's process, so for local mode; read by a query in parentheses, in two partitions."""
    import uuid

    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("K"), F.col("s_name").alias("N"), F.col("s_acctbal").alias("B"))
    W.inserted(rows, url, "SUPPLIERS", 500, **driver)
    found = R.rows_of(spark, url, "(SELECT K, N, B FROM SUPPLIERS WHERE MOD(K, 2) = 0) t", ["K < 20", "K >= 20"], **driver)
    return found.select(F.col("K").alias("s_suppkey"), F.col("N").alias("s_name"), F.col("B").alias("s_acctbal"))


@query("SELECT l_suppkey AS sample, count(*) AS n, round(sum(CASE WHEN l_suppkey % 3 = 0 THEN l_quantity * 2 ELSE l_quantity END), 2) AS total FROM lineitem GROUP BY 1")
def warehouse_load(spark, sf_dir):
    """All samples are loaded, then every third again with other numbers: a load replaces its own samples only."""
    path = scratch_path(spark, "warehouse")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), "l_orderkey", "l_quantity").repartition("sample")
    W.replaced(rows, path, "sample")
    W.replaced(rows.filter("sample % 3 = 0").withColumn("l_quantity", F.col("l_quantity") * 2), path, "sample")
    return spark.read.parquet(path).groupBy(F.col("sample").cast("long").alias("sample")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query(f"""WITH r AS (SELECT o_custkey AS c, {DAY.format('o_orderdate')} AS p FROM orders), k AS (SELECT c_custkey AS c, 9000 AS a, 9400 AS b FROM customer WHERE c_custkey % 2 = 0) SELECT c AS chromosome, p AS position FROM r WHERE EXISTS (SELECT 1 FROM k WHERE k.c = r.c AND p BETWEEN a AND b)""")
def region_restriction(spark, sf_dir):
    """Rows in the regions of a file: a scan restricted by chromosome and position."""
    c = F.col
    file = text(spark, table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(tabbed(c("c_custkey"), F.lit(8999), F.lit(9400))), "regions")
    regions = R.bed(spark, file).select(c("chromosome").cast("long").alias("chromosome"), c("start").alias("__a"), c("end").alias("__b"))
    rows = table(spark, sf_dir, "orders").select(c("o_custkey").alias("chromosome"), days("o_orderdate").alias("position"))
    found = I.range_join(rows.withColumn("__p", c("position")), regions, ["chromosome"], ("position", "__p"), ("__a", "__b"), 256)
    return found.select("chromosome", "position")

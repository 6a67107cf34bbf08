"""Readers for the text formats of the field, each a scan with an explicit schema; nothing is inferred.

Every reader takes paths that Spark's own readers open (globs and compressed files included) and returns typed columns; bad lines of
a typed format give nulls, as Spark's readers do in permissive mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def delimited(spark: SparkSession, path: str, schema: str, separator: str = "\t", nulls: str = "NULL") -> DataFrame:
    """A file with a header, read by column name: columns may stand in any order, and those that the file lacks are null."""
    raw = spark.read.csv(path, sep=separator, header=True, nullValue=nulls, inferSchema=False)
    wanted = spark.createDataFrame([], schema).schema
    return raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, start, end, name): half-open positions from 0 become inclusive ones from 1. Comment and track lines are left out."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    p = F.split("value", "\t")
    return lines.select(F.get(p, F.lit(0)).alias("chromosome"), (F.get(p, F.lit(1)).try_cast("long") + 1).alias("start"), F.get(p, F.lit(2)).try_cast("long").alias("end"), F.get(p, F.lit(3)).alias("name"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, start, end, mean) of either layout of segment files, told by the header."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False, enforceSchema=False)
    names = {"Chromosome": "chromosome", "Start": "start", "End": "end", "MeanRatio": "mean", "chrom": "chromosome", "start.pos": "start", "end.pos": "end", "mean": "mean"}
    kinds = {"chromosome": "string", "start": "long", "end": "long", "mean": "double"}
    return raw.select(*[F.col(f"`{c}`").try_cast(kinds[names[c]]).alias(names[c]) for c in raw.columns if c in names])


def gc_profile(spark: SparkSession, path: str, window: int = 1000, least_mappable: float = 0.85) -> DataFrame:
    """(chromosome, start, end, gc, non_n, mappable, is_mappable) of a headerless profile; starts become 1-based."""
    raw = spark.read.csv(path, sep="\t", schema="chromosome string, p long, gc double, non_n double, mappable double")
    return raw.select("chromosome", (F.col("p") + 1).alias("start"), (F.col("p") + window).alias("end"), "gc", "non_n", "mappable", (F.col("mappable") >= least_mappable).alias("is_mappable"))


def matrix(spark: SparkSession, path: str, row: str, separator: str = "\t") -> DataFrame:
    """(row, column, value) of a wide numeric matrix with names in its first column and header."""
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False)
    first, *rest = raw.columns
    return raw.select(F.col(f"`{first}`").alias(row), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in rest]).unpivot([row], rest, "column", "value")


def documents(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """JSON records of the given schema."""
    return spark.read.json(path, schema=schema, multiLine=multiline)


def rows_of(spark: SparkSession, url: str, source: str, predicates: list[str] | None = None, **properties: str) -> DataFrame:
    """A database's table, or a query in parentheses with an alias, over JDBC; predicates give one partition each. The driver's jar must be there."""
    if predicates:
        return spark.read.jdbc(url, source, predicates=predicates, properties=properties)
    return spark.read.jdbc(url, source, properties=properties)


_FIXED = ["chromosome", "position", "id", "ref", "alt", "qual", "filter", "info", "format"]


def variants(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, position, id, ref, alts, qual, filters, info map, genotypes array of maps) of variant files.

    A flag in info maps to an empty text. Genotype fields stand by sample in the header's order, under the format's names.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    p = F.split("value", "\t")
    row = lines.select(p.alias("p"), *[F.get(p, F.lit(i)).alias(n) for i, n in enumerate(_FIXED)])
    pairs = F.transform(F.filter(F.split("info", ";"), lambda x: ~x.isin("", ".")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("").alias("v")))
    names = F.split(F.coalesce("format", F.lit("")), ":")
    genotypes = F.transform(F.slice("p", F.lit(10), F.greatest(F.lit(0), F.size("p") - 9)), lambda g: F.map_from_entries(F.filter(F.arrays_zip(names.alias("k"), F.split(g, ":").alias("v")), lambda e: e["k"].isNotNull())))
    return row.select(
        "chromosome", F.col("position").try_cast("long").alias("position"), F.nullif("id", F.lit(".")).alias("id"), "ref", F.split("alt", ",").alias("alts"), F.col("qual").try_cast("double").alias("qual"),
        F.filter(F.split("filter", ";"), lambda x: ~x.isin(".", "PASS")).alias("filters"), F.map_from_entries(F.array_distinct(pairs)).alias("info"), genotypes.alias("genotypes"),
    )


def alignments(spark: SparkSession, path: str, regions: DataFrame | None = None, least_quality: int = 0, duplicates: bool = True, supplementary: bool = True) -> DataFrame:
    """Records of SAM text: name, flags, chromosome, position, mapping quality, cigar, mate, bases, qualities, tags map; end follows from the cigar.

    regions: a table (chromosome, start, end) that reads must overlap; they are merged, and a read that meets several comes once. The range join is by bins, so
    the table may be of any size.
    """
    from ..functions.sequences import cigar_length

    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    lines = lines.select(F.split("value", "\t").alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    tags = F.map_from_entries(F.transform(F.slice("p", F.lit(12), F.greatest(F.lit(0), F.size("p") - 11)), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v"))))
    reads = lines.select(
        at(0).alias("name"), at(1).try_cast("int").alias("flags"), at(2).alias("chromosome"), at(3).try_cast("long").alias("position"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_chromosome"), at(7).try_cast("long").alias("mate_position"), at(8).try_cast("long").alias("insert_size"), at(9).alias("bases"), at(10).alias("qualities"), tags.alias("tags"),
    )
    reads = reads.withColumn("end", F.col("position") + cigar_length(F.col("cigar"), "MDN=X") - 1).filter(F.col("mapq") >= least_quality)
    if not duplicates:
        reads = reads.filter(F.col("flags").bitwiseAND(F.lit(0x400)) == 0)
    if not supplementary:
        reads = reads.filter(F.col("flags").bitwiseAND(F.lit(0x800)) == 0)
    if regions is None:
        return reads
    from ..operators.intervals import merged, range_join

    wanted = merged(regions, ["chromosome"], "start", "end").select("chromosome", F.col("start").alias("__a"), F.col("end").alias("__b"))
    keyed = reads.withColumn("__row", F.monotonically_increasing_id())
    return range_join(keyed, wanted, ["chromosome"], ("position", "end"), ("__a", "__b"), 10_000).dropDuplicates(["__row"]).drop("__row", "__a", "__b")


def sequences(spark: SparkSession, path: str, chunk: int = 1000) -> DataFrame:
    """(contig, chunk, bases) of FASTA files, cut into chunks that join on chunk number; lines keep their order within a file.

    The files are dealt by record: a custom record separator puts each contig into one row of bounded length (a chromosome).
    """
    raw = spark.read.option("lineSep", ">").text(path).filter("value != ''")
    head = F.substring_index("value", "\n", 1)
    bases = F.regexp_replace(F.substring("value", F.length(head) + 2, F.length("value")), "\\s", "")
    # All chunks come from one pass over the contig; a substring for each would count characters from its start again and again.
    return raw.select(F.split(head, "\\s").getItem(0).alias("contig"), F.posexplode(F.regexp_extract_all(bases, F.lit(f".{{1,{chunk}}}"), F.lit(0))).alias("chunk", "bases"))


def base_string(chunks: DataFrame, regions: DataFrame, chunk: int = 1000) -> DataFrame:
    """The rows of regions (contig, start, end) with ``bases``: chunks are joined by number and put together."""
    first, last = F.floor((F.col("start") - 1) / chunk).cast("int"), F.floor((F.col("end") - 1) / chunk).cast("int")
    keyed = regions.withColumn("__row", F.struct(*regions.columns)).withColumn("chunk", F.explode(F.sequence(first, last)))
    found = keyed.join(chunks, ["contig", "chunk"]).groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("chunk", "bases"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["bases"]), "")
    offset = F.col("__row.start") - F.get("parts", F.lit(0))["chunk"] * chunk
    return found.select("__row.*", F.substring(text, offset.cast("int"), (F.col("__row.end") - F.col("__row.start") + 1).cast("int")).alias("bases"))


def reads_of(spark: SparkSession, path: str, umi_length: int = 0) -> DataFrame:
    """(name, bases, qualities) of FASTQ files; ``umi_length`` bases move from the front of the read into its name.

    Records are told by the separator of a newline and the name's sign. A quality line that begins with that sign is cut off its record: such a piece
    has no newline, and its record has no quality line. The piece is the next one of the file, and is joined back by that place; whole records are not shuffled. A record whose quality line is missing altogether has null qualities.
    """
    raw = spark.read.option("lineSep", "\n@").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    raw = raw.withColumn("value", F.regexp_replace("value", "\n$", ""))  # the file's end
    lines = F.split(F.regexp_replace("value", "^@", ""), "\n")
    raw = raw.withColumn("l", lines)
    read = lambda q: [F.get("l", F.lit(0)).alias("name"), F.get("l", F.lit(1)).alias("bases"), q.alias("qualities")]
    cut = (F.size("l") < 4) & F.get("l", F.lit(2)).startswith("+")
    whole = raw.filter((F.size("l") > 1) & ~F.coalesce(cut, F.lit(False))).select(*read(F.get("l", F.lit(3))))
    # What follows a record that was cut: the next row of its split, or the first one of the next split of its file that has any. One row for each split is sorted.
    blocks = raw.groupBy("file_path", "file_block_start").agg(F.min("at").alias("__first"), F.max("at").alias("__last"))
    blocks = blocks.withColumn("__next", F.lead("__first").over(Window.partitionBy("file_path").orderBy("file_block_start")))
    broken = raw.filter(cut).join(blocks, ["file_path", "file_block_start"]).withColumn("__at", F.when(F.col("at") < F.col("__last"), F.col("at") + 1).otherwise(F.col("__next")))
    rest = raw.filter(F.size("l") == 1).select(F.col("at").alias("__at"), F.col("value").alias("__rest"))
    joined = broken.join(rest, "__at", "left")
    row = whole.union(joined.select(*read(F.concat(F.lit("@"), "__rest"))))
    if not umi_length:
        return row
    cut: dict[str, Column] = {c: F.substring(c, F.lit(umi_length + 1), F.length(c)) for c in ("bases", "qualities")}
    return row.select(F.concat("name", F.lit("_"), F.substring("bases", 1, umi_length)).alias("name"), *[v.alias(k) for k, v in cut.items()])


def features(spark: SparkSession, path: str) -> DataFrame:
    """(chromosome, source, feature, start, end, strand, attributes map, every map) of GTF files: attributes has each key's first value, every has all of them, in order."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    p = F.split("value", "\t")
    at = lambda i: F.get(p, F.lit(i))
    keys, values = (F.regexp_extract_all(at(8), F.lit(r'(\w+) "([^"]*)"'), F.lit(i)) for i in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    firsts = F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(keys, e["k"]) == i + 1))
    every = F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("k"), F.transform(F.filter(pairs, lambda e: e["k"] == k), lambda e: e["v"]).alias("v"))))
    return lines.select(at(0).alias("chromosome"), at(1).alias("source"), at(2).alias("feature"), at(3).try_cast("long").alias("start"), at(4).try_cast("long").alias("end"), at(6).alias("strand"), firsts.alias("attributes"), every.alias("every"))


def flagstat(spark: SparkSession, path: str) -> DataFrame:
    """(label, passed, failed) of ``N + M label`` lines; other lines are an error's business and are left out."""
    pattern = r"^(\d+) \+ (\d+) ([^(]+?)(?: \(.*)?$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return spark.read.text(path).select(part(3).alias("label"), part(1).try_cast("long").alias("passed"), part(2).try_cast("long").alias("failed")).filter("label != ''")


def gene_cache(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Genes and exons of a transcript cache (CSV files with headers); protein_features, splice_acceptors and amino_acids where their files are there."""
    genes = delimited(spark, f"{folder}/ensembl_gene_data.csv", "GeneId string, GeneName string, Chromosome string, Strand int, GeneStart long, GeneEnd long, KaryotypeBand string, Synonyms string", ",")
    exons = delimited(spark, f"{folder}/ensembl_trans_exon_data.csv", "GeneId string, CanonicalTranscriptId string, Strand int, TransId int, TransName string, BioType string, TransStart long, TransEnd long, ExonRank int, ExonStart long, ExonEnd long, ExonPhase int, ExonEndPhase int, CodingStart long, CodingEnd long", ",")
    out = {"genes": genes, "exons": exons}
    more = {
        "protein_features": ("ensembl_protein_features.csv", "TranscriptId int, TranslationId int, ProteinFeatureId string, SeqStart int, SeqEnd int, HitDescription string"),
        "splice_acceptors": ("ensembl_trans_splice_data.csv", "GeneId string, TransId int, TransName string, TransStartPos long, PreSpliceAcceptorPosition long, Distance int"),
        "amino_acids": ("ensembl_trans_amino_acids.csv", "GeneId string, GeneName string, TransName string, Canonical boolean, AminoAcids string"),
    }
    for name, (file, schema) in more.items():
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            out[name] = delimited(spark, f"{folder}/{file}", schema, ",")
    return out


def normalised_frequencies(rows: DataFrame, locus: str, population: str, frequency: str) -> DataFrame:
    """Allele frequencies that add up to one in each locus and population."""
    total = rows.groupBy(locus, population).agg(F.sum(frequency).alias("__t"))
    return rows.join(total, [locus, population]).withColumn(frequency, F.col(frequency) / F.col("__t")).drop("__t")

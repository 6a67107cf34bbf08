import gzip
import json

from helixframe.sources import readers as R
from helixframe.sources import writers as W


def put(path, text):
    path.write_text(text)
    return str(path)


def test_delimited_by_name(spark, tmp_path):
    p = tmp_path / "a.tsv.gz"
    p.write_bytes(gzip.compress(b"b\ta\tx\n1.5\tq\t9\nNULL\tr\t8\nbad\ts\t7\n"))
    got = R.delimited(spark, str(p), "a string, b double, c long").collect()
    assert [tuple(r) for r in got] == [("q", 1.5, None), ("r", None, None), ("s", None, None)]


def test_bed_segments_profile_matrix(spark, tmp_path):
    bed = R.bed(spark, put(tmp_path / "a.bed", "track x\n#c\nchr1\t0\t10\tA\n2\t5\t6\n")).collect()
    assert [tuple(r) for r in bed] == [("chr1", 1, 10, "A"), ("2", 6, 6, None)]
    new = R.segments(spark, put(tmp_path / "n.pcf", "Chromosome\tStart\tEnd\tMeanRatio\n1\t1\t9\t0.5\n")).select("chromosome", "start", "end", "mean").first()
    old = R.segments(spark, put(tmp_path / "o.pcf", "sampleID\tchrom\tarm\tstart.pos\tend.pos\tn.probes\tmean\nS\t1\tp\t1\t9\t3\t0.5\n")).select("chromosome", "start", "end", "mean").first()
    assert tuple(new) == tuple(old) == ("1", 1, 9, 0.5)
    g = R.gc_profile(spark, put(tmp_path / "g.cnp", "1\t0\t0.4\t1\t0.9\n1\t1000\t-1\t0\t0\n")).collect()
    assert (g[0].start, g[0].end, g[0].is_mappable, g[1].is_mappable) == (1, 1000, True, False)
    m = R.matrix(spark, put(tmp_path / "m.tsv", "gene\ts1\ts2\nA\t1\t2\n"), "gene").collect()
    assert {tuple(r) for r in m} == {("A", "s1", 1.0), ("A", "s2", 2.0)}


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tT\tN
chr2\t5\t.\tA\tC,G\t.\tlow;bad\tDP=3;SOMATIC;X=a=b\tGT:AD\t0/1:3,4\t0/0
chr1\t9\trs1\tAT\tA\t10.5\tPASS\t.\tGT\t1/1\t0/1
"""


def test_variants_round_trip(spark, tmp_path):
    rows = R.variants(spark, put(tmp_path / "a.vcf", VCF))
    a, b = rows.orderBy("position").collect()
    assert (a.chromosome, a.position, a.id, a.alts, a.qual, a.filters) == ("chr2", 5, None, ["C", "G"], None, ["low", "bad"])
    assert a.info == {"DP": "3", "SOMATIC": "", "X": "a=b"} and a.genotypes[0] == {"GT": "0/1", "AD": "3,4"}
    assert b.info == {} and b.filters == [] and b.genotypes == [{"GT": "1/1"}, {"GT": "0/1"}]
    W.variants(rows.filter("position = 9"), str(tmp_path / "out"), ["T", "N"], 2)
    W.header(spark, str(tmp_path / "head"), {"FILTER=<ID=low": "x"}, ["T", "N"])
    again = R.variants(spark, str(tmp_path / "out")).first()
    assert again == b
    assert spark.read.text(str(tmp_path / "head")).count() == 3


SAM = """@HD\tVN:1.6
r1\t99\t1\t100\t60\t5S10M2D5M\t=\t300\t220\tACGTACGTACGTACGTACGT\tIIIIIIIIIIIIIIIIIIII\tNM:i:2
r2\t1123\t1\t500\t60\t20M\t2\t300\t0\tACGTACGTACGTACGTACGT\tIIIIIIIIIIIIIIIIIIII
r3\t0\t1\t700\t5\t20M\t*\t0\t0\tACGTACGTACGTACGTACGT\tIIIIIIIIIIIIIIIIIIII
"""


def test_alignments(spark, tmp_path):
    p = put(tmp_path / "a.sam", SAM)
    reads = {r.name: r for r in R.alignments(spark, p).collect()}
    assert reads["r1"].end == 116 and reads["r1"].mate_chromosome == "1" and reads["r1"].tags == {"NM": "i:2"[2:]}
    assert {r.name for r in R.alignments(spark, p, least_quality=10, duplicates=False).collect()} == {"r1"}
    regions = spark.createDataFrame([("1", 116, 200), ("1", 110, 120), ("1", 510, 511)], "chromosome string, start long, end long")
    assert sorted(r.name for r in R.alignments(spark, p, regions).collect()) == ["r1", "r2"]
    W.alignments(R.alignments(spark, p).filter("name = 'r3'"), str(tmp_path / "out"), 1)
    assert R.alignments(spark, str(tmp_path / "out")).first().cigar == "20M"


def test_fasta_fastq_gtf_flagstat(spark, tmp_path):
    bases = "ACGT" * 700
    fa = put(tmp_path / "a.fa", f">1 first\n{bases[:1500]}\n{bases[1500:]}\n>2\nTTTT\n")
    chunks = R.sequences(spark, fa)
    got = R.base_string(chunks, spark.createDataFrame([("1", 998, 2003), ("2", 2, 3)], "contig string, start long, end long"))
    assert {(r.contig, r.bases) for r in got.collect()} == {("1", bases[997:2003]), ("2", "TT")}
    fq = put(tmp_path / "a.fq", "@q1\nACGT\n+\nIIII\n@q2\nTTTTA\n+\nIIIII\n")
    assert {tuple(r) for r in R.reads_of(spark, fq, 2).collect()} == {("q1_AC", "GT", "II"), ("q2_TT", "TTA", "III")}
    gtf = R.features(spark, put(tmp_path / "a.gtf", '#x\n1\tsrc\texon\t5\t9\t.\t+\t.\tgene_id "G1"; tag "a"; tag "b";\n')).first()
    assert (gtf.feature, gtf.start, gtf.attributes["gene_id"], gtf.attributes["tag"]) == ("exon", 5, "G1", "a")
    stat = R.flagstat(spark, put(tmp_path / "f", "10 + 2 in total (QC-passed reads + QC-failed reads)\n5 + 0 mapped (50.00% : N/A)\nbroken\n")).collect()
    assert [tuple(r) for r in stat] == [("in total", 10, 2), ("mapped", 5, 0)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0)], "sampleId string, n int, v double")
    W.delimited(rows, str(tmp_path / "d"), ["v", "n"])
    assert {tuple(r) for r in R.delimited(spark, str(tmp_path / "d"), "n int, v double").collect()} == {(1, 2.0), (2, 3.0)}
    W.replaced(rows, str(tmp_path / "t"))
    W.replaced(rows.filter("sampleId = 'b'").withColumn("n", rows["n"] + 10), str(tmp_path / "t"))
    assert {(r.sampleId, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 12)}
    W.ratios(spark.createDataFrame([("1", 1, 5.0)], "chromosome string, position long, tumorReadDepth double"), str(tmp_path / "r"))
    assert R.delimited(spark, str(tmp_path / "r"), "tumorReadDepth double, tumorGCRatio double").first() == (5.0, -1.0)
    W.segments(spark.createDataFrame([("1", 1, 5, 0.5)], "chromosome string, start long, end long, mean double"), str(tmp_path / "s"))
    assert R.segments(spark, str(tmp_path / "s")).first()["mean"] == 0.5
    out = {r.sampleId: json.loads(r.report) for r in W.report(rows, {"numbers": rows, "none": rows.filter("n = 2")}).collect()}
    assert out["a"] == {"numbers": [{"n": 1, "v": 2.0}], "none": []}


def test_quality_lines_that_begin_with_the_sign_over_small_splits(spark, tmp_path):
    import random

    rng = random.Random(3)
    want = []
    folder = tmp_path / "fq"
    folder.mkdir()
    for f in range(3):
        rows = []
        for i in range(120):
            n = rng.randrange(1, 9)
            rows.append((f"q{f}.{i}", "".join(rng.choice("ACGT") for _ in range(n)), rng.choice("@@+I") + "".join(rng.choice("@F+") for _ in range(n - 1))))
        rows[-1] = (f"q{f}.last", "ACG", "@@I")
        (folder / f"{f}.fq").write_text("".join(f"@{a}\n{b}\n+\n{q}\n" for a, b, q in rows))
        want += rows
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("134217728b", "200b", "61b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            assert sorted(tuple(r) for r in R.reads_of(spark, str(folder)).collect()) == sorted(want), size
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_long_contig_and_repeated_keys(spark, tmp_path):
    import time

    p = tmp_path / "long.fa"
    p.write_text(">1 long\n" + "".join("ACGTTGCAAC" * 8 + "\n" for _ in range(100_000)))
    began = time.time()
    assert R.sequences(spark, str(p)).count() == 8000
    assert time.time() - began < 60
    gtf = R.features(spark, put(tmp_path / "b.gtf", '1\ts\texon\t5\t9\t.\t+\t.\tgene_id "G1"; tag "a"; tag "b";\n')).first()
    assert gtf.attributes["tag"] == "a" and gtf.every == {"gene_id": ["G1"], "tag": ["a", "b"]}

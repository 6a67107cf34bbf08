"""Rows that ``explode`` makes are not in the planner's size of a side, so joins on such sides must not be broadcast."""

from pyspark.sql import functions as F

from helixframe.operators import haplotypes as H
from helixframe.operators import intervals as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_joins_are_not_broadcast(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("k")).write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    spans = keys.select("k", F.explode(F.array(*[F.lit(100 * i) for i in range(9)])).alias("a")).withColumn("b", F.col("a") + 50)
    points = spark.range(1000).select((F.col("id") % 100).alias("k"), F.col("id").alias("p")).withColumn("q", F.col("p"))
    for how in ("inner", "left"):
        got = I.range_join(points, spans, ["k"], ("p", "q"), ("a", "b"), 64, how)
        assert "SortMergeJoin" in plan(got)
        joined = [line for line in plan(got).splitlines() if "Broadcast" in line and "__bin" in line]
        assert not joined
        want = sum(1 for p in range(1000) for a in range(0, 900, 100) if a <= p <= a + 50)
        assert got.filter("a IS NOT NULL").count() == want


def test_alleles_are_not_broadcast(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("allele")).write.parquet(str(tmp_path / "alleles"))
    alleles = spark.read.parquet(str(tmp_path / "alleles")).select("allele", (F.col("allele") % 4).alias("gene"), F.explode(F.array(F.lit(1), F.lit(2))).alias("locus"), F.lit("A").alias("letter"))
    haplotypes = spark.createDataFrame([(0, 1, [1, 2], "AA", 5), (1, 1, [1, 2], "AC", 5)], "gene long, first int, loci array<int>, haplotype string, n long")
    got = H.agreeing_alleles(alleles, haplotypes, ["gene"])
    inner = [line for line in plan(got).splitlines() if "Broadcast" in line and ("locus" in line or "LeftOuter" in line)]
    assert not inner and plan(got).count("SortMergeJoin") >= 2
    assert {r.allele for r in got.collect()} == {a for a in range(40) if a % 4 != 1}

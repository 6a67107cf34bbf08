"""Chains and rings: an order's items stand for the variants of a cluster."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chaining as C
from ..storage import table
from .registry import query


def variants(spark, sf_dir):
    """Variants on two chromosomes with 1, 2 or 4 copies; every eleventh is a single breakend."""
    c = F.col
    way = lambda x: F.when(x % 2 == 0, 1).otherwise(-1)
    single = c("l_suppkey") % 11 == 0
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("cluster"), c("l_linenumber").cast("long").alias("variant"), (c("l_partkey") % 2).cast("string").alias("chromosome_start"), (c("l_partkey") * 37 % 10_000).cast("long").alias("position_start"), way(c("l_partkey")).alias("orientation_start"),
        F.when(~single, (c("l_suppkey") % 2).cast("string")).alias("chromosome_end"), F.when(~single, c("l_suppkey") * 101 % 10_000).cast("long").alias("position_end"), F.when(~single, way(c("l_linenumber") + c("l_suppkey"))).alias("orientation_end"),
        F.pow(F.lit(2.0), (c("l_partkey") % 3).cast("double")).alias("copies"), F.lit(0.0).alias("spread"), (c("l_discount") * 20).cast("double").alias("beside_start"), (c("l_tax") * 20).cast("double").alias("beside_end"),
    )


@query()
def copy_number_chains(spark, sf_dir):
    return C.chains(variants(spark, sf_dir), ["cluster"])


@query()
def chain_links(spark, sf_dir):
    return C.chain_links(variants(spark, sf_dir), ["cluster"])


@query()
def double_minutes(spark, sf_dir):
    v = variants(spark, sf_dir).withColumn("copies", 3 + 2 * F.col("copies"))
    return C.rings(v, ["cluster"]).withColumn("copies", F.round("copies", 8))

"""Fitted models: items stand for reads at repeats, suppliers and customers for samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..storage import table
from .registry import query

#: Shares of line numbers and remainders of part keys that stand for three processes.
PROFILES = {"early": {"1_0": 0.3, "2_1": 0.3, "3_2": 0.2, "1_3": 0.2}, "late": {"5_0": 0.4, "6_1": 0.3, "7_2": 0.3}, "even": {f"{m}_{i}": 1 / 28 for m in range(1, 8) for i in range(4)}}


@query()
def jitter_models(spark, sf_dir):
    """Units of one and two bases with 4 to 15 copies; an item stands for as many reads as its quantity times 40, mostly without jitter."""
    c = F.col
    j = F.when(c("l_partkey") % 5 == 0, (c("l_suppkey") % 7 - 3).cast("int")).otherwise(0)
    r = table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("sample"), F.when(c("l_linestatus") == "O", "A").otherwise("AC").alias("unit"), (4 + c("l_orderkey") % 12).cast("int").alias("copies"), j.alias("j"), (c("l_quantity") * 40).cast("long").alias("n"))
    got = M.jitter_models(r, ["sample"], "unit", "copies", "j", "n")
    return got.select("sample", "unit", *[F.round(x, 6).alias(x) for x in ("scale4", "scale5", "scale6", "gradient", "intercept", "skew")])


def contexts(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat_ws("_", c("l_linenumber").cast("string"), (c("l_partkey") % 4).cast("string")).alias("context"), c("l_quantity").cast("long").alias("n"))


@query()
def refined_signatures(spark, sf_dir):
    got = M.refined_signatures(contexts(spark, sf_dir), "l_suppkey", "context", "n", PROFILES)
    return got.withColumns({"allocation": F.round("allocation", 3), "percent": F.round("percent", 5)})


@query()
def signature_discovery(spark, sf_dir):
    """Profiles that are found in the suppliers' counts, with how many suppliers and counts each explains."""
    profiles, given = M.discovered(contexts(spark, sf_dir), "l_suppkey", "context", "n", rounds=6)
    use = given.groupBy("signature").agg(F.count("*").alias("samples"), F.round(F.sum("allocation"), 3).alias("explained"))
    return profiles.join(use, "signature").select("signature", "context", F.round("share", 8).alias("share"), "samples", "explained")

import random

from pyspark.sql import functions as F
from test_collapse import greedy

from helixframe.operators import immune


def test_only_pieces_that_are_sequences_of_no_more_reads_meet(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(500)})
    rows = [(i, w, 1 + i % 3) for i, w in enumerate(words)] + [(1000, words[0][3:9], 1), (1001, words[0][4:8], 9), (1002, words[1][:7], 1)]
    df = spark.createDataFrame(rows, "id long, s string, n long").withColumn("l", F.struct(F.lit("x").alias("own"))).withColumn("own", F.xxhash64("l"))
    got = {(r.s, r.to) for r in immune.held_pieces(df, 20).collect()}
    assert {(words[0][3:9], 0), (words[1][:7], 1)} <= got
    # All pieces of all words, which met before, are 232,000.
    assert len(got) < 500


def test_empty_wide_and_null_sequences(spark):
    words = ["", "", "é", "éa", "日本語", "本", "日本誤", "日x誤", "a", "ab", "a", "日本語"]
    rows = [(l, w) for l in ("x", None) for w in words] + [("y", ""), ("x", None)]
    got = {(r.l, r.s): r.support for r in immune.collapsed_sequences(spark.createDataFrame(rows, "l string, s string"), "l", "s").collect()}
    assert got == {(l, s): n for l in ("x", None) for s, n in greedy(words).items()} | {("y", ""): 1}

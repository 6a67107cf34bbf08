"""Tasks grow in number with the rows, and not in memory."""

from pyspark.sql import functions as F

from helixframe.operators import intervals as I
from helixframe.operators import quality as K


def closed(edges):
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return out


def test_ancestors_of_trees_chains_cycles_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(K, "TASK_ROWS", 20, raising=False)
    made = []
    monkeypatch.setattr(K, "stored", lambda df, what, _own=K.stored: made.append((what, df)) or _own(df, what))
    edges = [(i, i // 3) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 113)] + [(200, 201), (201, 202), (202, 200)] + [(300, 301), (300, 301), (300, 302), (301, 303), (302, 303)]
    got = K.ancestors(spark.createDataFrame(edges, "term long, ancestor long"), "term", "ancestor").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == closed(edges)
    # A step of exactly a power of two: of pairs that are known by a shorter one too there are none on a chain.
    steps = [df for what, df in made if what == "steps"]
    assert [sum(100 <= r.term < 120 for r in s.collect()) for s in steps][:3] == [12, 10, 6]
    assert steps[0].rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_asof_tasks(spark):
    left = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("p"))
    right = spark.range(0, 2000, 3).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    got = I.asof_join(left, right, ["k"], "p", "t", ["v"], bucket=64, tasks=11)
    assert got.rdd.getNumPartitions() == 11
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in I.asof_join(left, right, ["k"], "p", "t", ["v"]).collect()}

import numpy as np
from pyspark.sql import functions as F

from helixframe.llm import near_copies as N


def test_fingerprints_are_the_majority_of_bits():
    sets = [np.random.default_rng(i).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for i, n in enumerate((1, 2, 9, 300))]
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in sets]
    assert [int(x) for x in N.fingerprints(sets).view(np.uint64)] == want


def test_candidates_come_through_multi_index_hashing(spark):
    sims = [0, 0b11, 0b1111, 0b1111 << 20, -1, -1]
    rows = spark.createDataFrame([(i, 9, s) for i, s in enumerate(sims)], "fp long, n long, sim long")
    got = {frozenset(r.m) for r in N.hashed(rows).groupBy("band").agg(F.collect_list("fp").alias("m")).collect()}
    assert got == {frozenset({0, 1, 2}), frozenset({3}), frozenset({4, 5})}
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "A b c d e f g h i j k l"), (3, "m n o p q r s t u v w x"), (4, None)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in N.near_copies(docs).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert "sim" in N.sketched(docs, "doc_id", "text").columns

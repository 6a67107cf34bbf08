"""Operators without SQL against brute force, and edge cases."""

import itertools
import math
import random

import numpy as np
import pytest

from helixframe.functions import sequences as Q
from helixframe.functions import stats as S
from helixframe.operators import diff, fits, graph, grids, immune, segmentation
from helixframe.operators import intervals as I
from helixframe.operators import variants as V


@pytest.mark.parametrize("seed", range(6))
def test_segments_are_optimal(seed):
    rng = np.random.default_rng(seed)
    v = np.concatenate([rng.normal(m, 0.3, n) for m, n in ((1, 5), (3, 4), (1.5, 4))])
    cost = [0.0001, 0.5, 1.0, 3.0, 50.0, 0.2][seed]
    total = lambda s: sum(((v[i : j + 1] - v[i : j + 1].mean()) ** 2).sum() + cost for i, j, _ in s)
    got = segmentation.segments(v, cost)
    best = math.inf
    for k in range(len(v)):
        for at in itertools.combinations(range(1, len(v)), k):
            cuts = (0, *at, len(v))
            best = min(best, total([(a, b - 1, 0) for a, b in zip(cuts, cuts[1:])]))
        if k > 4 and cost > 0.1:
            break
    assert total(got) <= best + 1e-9
    assert [i for i, _, _ in got] == [0, *[j + 1 for _, j, _ in got[:-1]]]


def test_running_median_and_penalty():
    v = np.array([1.0, 9, 2, 3, 100, 4, 5])
    assert segmentation.running_median(v, 3)[1:-1].tolist() == [2, 3, 3, 4, 5]
    assert segmentation.penalty(np.ones(200)) == 1.0
    assert segmentation.penalty(np.random.default_rng(0).normal(5, 1, 500), 100) == pytest.approx(100, rel=0.3)


def test_one_penalty_over_blocks_is_that_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, p, float(v) if p % 17 else None) for k in ("a", "b", "c") for p, v in enumerate(rng.normal(1, 0.2, 190))]
    whole = np.array([v for _, _, v in rows if v is not None])
    df = spark.createDataFrame(rows, "k string, p long, v double")
    rest = whole - segmentation.running_median(whole)
    want = 10 * (1.4826 * np.median(np.abs(rest - np.median(rest)))) ** 2
    for size in (10_000, 60):
        monkeypatch.setattr(segmentation, "BLOCK", size)
        assert segmentation.penalty_of(df, ["k"], "p", "v", 10.0) == pytest.approx(want, rel=1e-12)
    assert segmentation.penalty_of(df.filter("v < -9"), ["k"], "p", "v", 10.0) == 0.1
    flat = spark.createDataFrame([("a", i, 0.0 if i < 30 else 4.0) for i in range(60)], "k string, p long, v double")
    got = segmentation.segmented(flat.withColumn("l", segmentation.log_ratio(flat["v"])), ["k"], "p", "l", 1.0, window=10, raw="v").collect()
    assert [(r.start, r.end, r.n, r["mean"]) for r in got] == [(0, 38, 30, 0.0), (30, 68, 30, 4.0)]


def test_probabilities():
    assert S.poisson_cdf_one(3, 2.0) == pytest.approx(sum(math.exp(-2) * 2**k / math.factorial(k) for k in range(4)))
    assert S.poisson_cdf_one(1000, 1000) == pytest.approx(0.5, abs=0.02)
    assert S.binomial_cdf_one(2, 5, 0.3) == pytest.approx(sum(math.comb(5, k) * 0.3**k * 0.7 ** (5 - k) for k in range(3)))
    assert S.poisson_cdf_one(10, S.poisson_noise_one(10, 0.05)) == pytest.approx(0.05, abs=1e-4)
    tail = sum(math.comb(10, k) * math.comb(10, 10 - k) for k in range(8, 11)) / math.comb(20, 10)
    assert S.fisher_one(8, 2, 2, 8) == pytest.approx(tail)
    assert math.isnan(S.fisher_one(10**4, 1, 1, 1))


def test_nnls_and_factors():
    rng = np.random.default_rng(3)
    a = rng.random((12, 4))
    for x in ([1, 0, 2, 0], [0, 0, 0, 0], [0.5, 3, 0, 1]):
        assert fits.nnls(a, a @ np.array(x, float)) == pytest.approx(x, abs=1e-6)
    b = rng.normal(size=12)
    x = fits.nnls(a, b)
    g = a.T @ (b - a @ x)
    assert (x >= 0).all() and (g <= 1e-8).all() and np.abs(g[x > 0]).max(initial=0) < 1e-8
    v = rng.random((8, 2)) @ rng.random((2, 9))
    w, h = fits.nmf(v, 2, 3000)
    assert np.abs(w @ h - v).max() < 0.02


def test_expectation_maximisation(spark):
    rows = [("g", ["a"], 30.0), ("g", ["b"], 10.0), ("g", ["a", "b"], 40.0)]
    got = {r.member: r.abundance for r in fits.abundance(spark.createDataFrame(rows, "gene string, sets array<string>, n double"), "gene", "sets", "n", 200, 1e-9).collect()}
    assert got["a"] == pytest.approx(60, abs=1e-3) and got["b"] == pytest.approx(20, abs=1e-3)


def test_umi_network(spark):
    rows = [(1, "AAAA", 100), (1, "AAAT", 10), (1, "AATT", 4), (1, "CCCC", 5), (1, "CCCG", 5), (2, "AAAA", 1)]
    got = {(r.p, r.umi): r.group for r in fits.umi_groups(spark.createDataFrame(rows, "p int, umi string, n long"), ["p"], "umi", "n").collect()}
    assert got == {(1, "AAAA"): "AAAA", (1, "AAAT"): "AAAA", (1, "AATT"): "AAAA", (1, "CCCC"): "CCCC", (1, "CCCG"): "CCCG", (2, "AAAA"): "AAAA"}


def test_components_match_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(-40, 160), rng.randrange(-40, 160)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(500, k) for k in range(501, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root if find(x) != x} | {x: x for x in got if find(x) == x and got[x] == x}


def test_range_and_asof_joins_match_brute_force(spark):
    rng = random.Random(1)
    left = [(rng.choice("ab"), i, rng.randrange(300)) for i in range(60)]
    right = [(rng.choice("ab"), j, s, s + rng.randrange(40)) for j in range(40) for s in [rng.randrange(300)]]
    a = spark.createDataFrame(left, "k string, i int, p long").withColumn("q", __import__("pyspark.sql.functions", fromlist=["col"]).col("p") + 5)
    b = spark.createDataFrame(right, "k string, j int, s long, e long")
    want = {(i, j) for k, i, p in left for m, j, s, e in right if k == m and p <= e and s <= p + 5}
    assert {(r.i, r.j) for r in I.range_join(a, b, ["k"], ("p", "q"), ("s", "e"), 16).collect()} == want
    outer = I.range_join(a, b, ["k"], ("p", "q"), ("s", "e"), 16, "left").collect()
    assert {(r.i, r.j) for r in outer} == want | {(i, None) for _, i, _ in left if i not in {x for x, _ in want}}
    for bucket, tolerance in ((None, None), (32, None), (32, 20)):
        got = {r.i: r.s0 for r in I.asof_join(a, b.groupBy("k", "s").agg({"j": "max"}).selectExpr("k", "s", "s AS s0"), ["k"], "p", "s", ["s0"], bucket, tolerance).collect()}
        best = {i: max((s for m, _, s, _ in right if m == k and s <= p and (tolerance is None or p - s <= tolerance)), default=None) for k, i, p in left}
        assert got == best


def test_diff_rules(spark):
    old = spark.createDataFrame([(1, 1.0, "x"), (1, 2.0, "x"), (2, 5.0, None), (3, 0.0, "z"), (4, None, "q")], "k int, v double, s string")
    new = spark.createDataFrame([(1, 1.0, "x"), (2, 5.5, None), (3, 0.0, "y"), (4, 1.0, "q"), (9, 1.0, "n")], "k int, v double, s string")
    got = {(r.k, r.mismatch, r.fields) for r in diff.compared(old, new, ["k"], [diff.Field("v", 0.4), diff.Field("s")]).collect()}
    assert got == {(1, "OLD_ONLY", ""), (2, "VALUE", "v"), (3, "VALUE", "s"), (4, "VALUE", "v"), (9, "NEW_ONLY", "")}
    assert len(diff.CATEGORIES) == 29 and diff.CATEGORIES["virus"][1][1] == diff.Field("integrations", None, 0.2)
    rows = spark.createDataFrame([("s", "EBV", 3, 10.0)], "SampleId string, Name string, integrations int, meanCoverage double")
    assert diff.compare_category("virus", rows, rows.withColumn("integrations", rows["integrations"] + 1)).first().fields == "integrations"


def test_haplotypes():
    known = {"*1": {}, "*2": {"a": 1}, "*3": {"a": 1, "b": 1}, "*4": {"b": 1}}
    assert immune.haplotypes({"a": 0, "b": 0}, known, "*1") == {"*1": 2}
    assert immune.haplotypes({"a": 1, "b": 0}, known, "*1") == {"*2": 1, "*1": 1}
    assert immune.haplotypes({"a": 1, "b": 1}, known, "*1") == {"*2": 1, "*4": 1}
    assert immune.haplotypes({"a": 2, "b": 2}, known, "*1") == {"*3": 2}
    assert immune.haplotypes({"a": None, "b": 0}, known, "*1") == {} == immune.haplotypes({"c": 1}, known, "*1")


def test_sequence_functions(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        Q.reverse_complement(F.lit("AACGT")).alias("rc"), Q.translated(F.lit("ATGAAATAGC")).alias("aa"), Q.longest_repeat(F.lit("GGACACACTTTT"), 2).alias("rep"), Q.homology(F.lit("ACGTT"), F.lit("ACGA"), 5).alias("hom"),
        Q.hgvs_parts(F.lit("c.12_14delinsAC")).alias("h"), Q.kmers(F.lit("AB"), 3).alias("none"), Q.gc_content(F.lit("")).alias("gc"),
    ).first()
    assert (row.rc, row.aa, row.rep, row.hom, row.none, row.gc) == ("ACGTT", "MK*", "ACACAC", 3, [], None)
    assert (row.h.start, row.h.end, row.h.kind, row.h.alt) == (12, 14, "delins", "AC")
    assert len(Q.TRINUCLEOTIDES) == 96 and Q.TRINUCLEOTIDES[0] == "C>A_ACA"


def test_grid_choice_and_ranks(spark):
    scores = spark.createDataFrame([(float(i), s) for i, s in enumerate([5.0, 3.0, 3.0, 4.0, 1.0])], "level double, score double")
    assert grids.first_lowest(scores, patience=2) == 1.0 and grids.first_lowest(scores) == 4.0
    ranks = spark.createDataFrame([("chr1",), ("X",), ("chrM",), ("22",), ("GL1",)], "c string").select(V.contig_rank(__import__("pyspark.sql.functions", fromlist=["col"]).col("c")).alias("r")).collect()
    assert [r.r for r in ranks] == [1, 23, 25, 22, None]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k string, s long, e long, v double")
    assert I.merged(e, ["k"], "s", "e").count() == 0 == I.coverage(e, ["k"], "s", "e").count()
    assert segmentation.segmented(e, ["k"], "s", "v", 1.0).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0

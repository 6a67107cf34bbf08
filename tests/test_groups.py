"""Operators over groups against plain loops: phase sets, discordant groups, smoothing, homozygous runs, ranks."""

import random

from helixframe.operators import fits, graph, reads, receptors, segmentation


def test_phase_sets(spark):
    r = random.Random(1)
    rows = [(i % 3, [r.randrange(6) for _ in range(r.randrange(0, 5))]) for i in range(300)]
    got = {(x.region, tuple(x.set)): x.support for x in reads.phase_sets(spark.createDataFrame(rows, "region int, v array<int>"), "region", "v", 4).collect()}
    want = {}
    for region in range(3):
        counts = {}
        for k, v in rows:
            if k == region and v:
                counts[frozenset(v)] = counts.get(frozenset(v), 0) + 1
        kept = {}
        for s in sorted(counts, key=lambda s: (-len(s), sorted(s))):
            over = [k for k in kept if s < k]
            if len(over) == 1:
                kept[over[0]] += counts[s]
            elif not over:
                kept[s] = counts[s]
        want |= {(region, tuple(sorted(s))): n for s, n in kept.items() if n >= 4}
    assert got == want


def test_discordant_groups(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    rows = [(i, r.choice("ab"), r.randrange(900), r.randrange(900)) for i in range(120)]
    got = {x.id: x.cluster for x in graph.bands(spark.createDataFrame(rows, "id long, k string, x long, y long"), ["k"], F.col("x"), F.col("y"), 40, "id").collect()}
    root = {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, k, x, y in rows:
        for j, m, p, q in rows:
            if k == m and abs(x // 40 - p // 40) <= 1 and abs(y // 40 - q // 40) <= 1:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i, *_ in rows}


def test_smoothing_by_hand_and_its_sums(spark):
    rows = [("a", 10 * i, 10 * i + 9, v, w) for i, (v, w) in enumerate([(2.0, 50.0), (2.1, 100.0), (2.2, 4.0), (3.9, 60.0), (4.0, 70.0), (2.0, 0.0)])]
    made = segmentation.smoothed_copy_number(spark.createDataFrame(rows, "k string, s long, e long, v double, w double"), ["k"], "s", "e", "v", "w", 0.3).collect()
    got = sorted((x.start, x.end, round(x.value, 6), x.weight, x.n) for x in made)
    assert got == [(0, 29, round((100 + 210 + 8.8) / 154, 6), 154.0, 3), (30, 49, round((3.9 * 60 + 280) / 130, 6), 130.0, 2), (50, 59, 2.0, 0.0, 1)]
    r = random.Random(3)
    rows = [(k, 10 * i, 10 * i + 9, r.choice([1.0, 2.0, 3.0]) + r.random() / 4, float(r.randrange(30))) for k in "ab" for i in range(60)]
    made = segmentation.smoothed_copy_number(spark.createDataFrame(rows, "k string, s long, e long, v double, w double"), ["k"], "s", "e", "v", "w", 0.3).collect()
    for k in "ab":
        own = sorted((x for x in made if x.k == k), key=lambda x: x.start)
        assert [x.end + 1 for x in own[:-1]] == [x.start for x in own[1:]] and sum(x.n for x in own) == 60
        assert abs(sum(x.weight for x in own) - sum(w for q, *_, w in rows if q == k)) < 1e-9


def test_homozygous_runs(spark):
    r = random.Random(4)
    rows = [(k, 100 * i, r.random() < (0.02 if 40 < i < 120 else 0.5)) for k in "ab" for i in range(200)]
    got = fits.homozygous_runs(spark.createDataFrame(rows, "k string, p long, het boolean"), ["k"], "p", "het", 20, 3, 30, 2000).collect()
    assert {x.k for x in got} == {"a", "b"}
    for x in got:
        inside = [h for k, p, h in rows if k == x.k and x.start <= p <= x.end]
        assert len(inside) == x.n >= 30 and sum(inside) == x.n_het and x.end - x.start + 1 >= 2000 and not inside[0] and not inside[-1]
        assert max(sum(inside[i : i + 20]) for i in range(len(inside))) <= 3
        after = [h for k, p, h in rows if k == x.k and p > x.end]
        # It ends because a window that goes on has too many, and not before.
        assert not after or max(sum(inside[-(20 - n) :] + after[:n]) for n in range(1, 20)) > 3


def test_score_ranks(spark):
    r = random.Random(5)
    random_scores = [("x", r.random()) for _ in range(400)]
    scores = [("x", f"p{i}", r.random()) for i in range(50)] + [("x", "low", -1.0), ("x", "high", 2.0)]
    got = {x.peptide: x.rank for x in receptors.score_ranks(spark.createDataFrame(scores, "allele string, peptide string, score double"), spark.createDataFrame(random_scores, "allele string, score double"), ["allele"], 100).collect()}
    for _, name, score in scores:
        share = sum(s > score for _, s in random_scores) / len(random_scores)
        assert abs(got[name] - share) <= 0.02
    assert got["low"] == 1 and got["high"] == 0

"""Ordered scans give the same over small buckets as in one, and as plain Python does."""

import random

import pytest

from helixframe.operators import depth as D
from helixframe.operators import intervals as I

RNG = random.Random(5)
SPANS = [(k, a, a + RNG.choice([0, 1, 5, 40])) for k in (1, 2, None) for a in (RNG.randrange(400) for _ in range(60))]
POINTS = [(i, k, RNG.randrange(300), RNG.choice("abc" if i % 3 else "a")) for i, k in enumerate([1, 1, 2, None] * 30)]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_merge_subtract_coverage(spark, bucket):
    df = spark.createDataFrame(SPANS, "k int, a long, b long")
    covered = {k: sorted({p for x, a, b in SPANS if x == k for p in range(a, b + 1)}) for k in (1, 2, None)}
    for gap in (0, 3):
        want = []
        for k, ps in covered.items():
            start = ps[0]
            for p, q in zip(ps, [*ps[1:], 10**6]):
                if q - p > 1 + gap:
                    want.append((k, start, p, sum(x == k and start <= a <= p for x, a, _ in SPANS)))
                    start = q
        assert rows(I.merged(df, ["k"], "a", "b", gap, bucket), "k", "a", "b", "n") == sorted(want, key=str)
    depth = {k: [sum(x == k and a <= p <= b for x, a, b in SPANS) for p in range(460)] for k in covered}
    got = {k: [0] * 460 for k in covered}
    for k, a, b, d in rows(I.coverage(df, ["k"], "a", "b", bucket), "k", "a", "b", "depth"):
        got[k][a : b + 1] = [d] * (b - a + 1)
    assert got == depth
    targets = spark.createDataFrame([(i, k, a, a + w) for i, (k, a, w) in enumerate([(1, 0, 500), (2, 100, 30), (None, 0, 3), (3, 5, 9), (1, 450, 40)])], "t int, k int, a long, b long")
    free = {}
    for t, a, b in rows(I.subtracted(targets.filter("k IS NOT NULL"), df, ["k"], "a", "b", 16, "t", bucket), "t", "a", "b"):
        free.setdefault(t, set()).update(range(a, b + 1))
    for t, k, a, b in targets.filter("k IS NOT NULL").collect():
        assert free.get(t, set()) == set(range(a, b + 1)) - set(covered.get(k, [])), t
    deep = rows(I.high_depth(df, ["k"], "a", "b", 2, 4, bucket), "k", "a", "b", "first_depth", "max_depth")
    assert deep == rows(I.high_depth(df, ["k"], "a", "b", 2, 4, 10**6), "k", "a", "b", "first_depth", "max_depth") and len(deep) > 10


@pytest.mark.parametrize("bucket", [1, 5, 1000])
def test_islands_and_nearest(spark, bucket):
    df = spark.createDataFrame(POINTS, "i int, k int, p long, o string")
    order = {k: sorted((p, o, i) for i, x, p, o in POINTS if x == k) for k in (1, 2, None)}
    near, isle = {}, {}
    for own in order.values():
        n = 1
        for j, (p, o, i) in enumerate(own):
            n += j > 0 and p - own[j - 1][0] > 4
            isle[i] = n
            before = [q for q, x, _ in own[:j] if x != o]
            behind = [q for q, x, _ in own[j:] if x != o]
            near[i] = min([p - before[-1]] if before else [], default=None) if not behind else min([behind[0] - p] + ([p - before[-1]] if before else []))
    assert {r.i: r.island for r in I.islands(df, ["k"], "p", 4, bucket).collect()} == isle
    assert {r.i: r.nearest for r in I.nearest(df, ["k"], "p", "o", bucket).collect()} == near


def test_rolling_median_over_blocks(spark):
    data = [(k, p, RNG.choice([-1.0, 0.5, 1.0, 1.5, 2.0, 3.0])) for k in (1, 2) for p in range(0, 9000, 3)]
    df = spark.createDataFrame(data, "k int, p long, v double")
    want = {}
    for k in (1, 2):
        own = [(p, v) for x, p, v in data if x == k and v > 0]
        for j, (p, v) in enumerate(own):
            frame = sorted(x for _, x in own[max(0, j - 3) : j + 4])
            n = len(frame)
            want[k, p] = v if n < 5 else round(v / ((frame[(n - 1) // 2] + frame[n // 2]) / 2), 9)
    for bucket in (50, 10**6):
        got = {(r.k, r.p): round(r.rolled, 9) for r in D.rolling_median(df, ["k"], "p", "v", 3, 5, bucket=bucket).collect()}
        assert got == want


def test_asof_ties_take_the_largest_values(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 9)], "k int, t long")
    right = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "z"), (2, 10, "y")], "k int, u long, v string")
    for bucket in (None, 2):
        assert rows(I.asof_join(left, right, ["k"], "t", "u", ["v"], bucket), "k", "t", "v") == [(1, 5, "b"), (1, 9, "b"), (2, 9, None)]

"""Jitter fits against loops and simulated reads; signature fits within noise; planted signatures found."""

import itertools
import math

import numpy as np
import pytest

from helixframe.operators import models as M
from helixframe.operators.fits import nnls


def plain_loss(counts, scale, skew, before):
    k = 1 + (skew - 1) * min(scale, 1)
    raw = [math.exp(-abs(x) * (k if x >= 0 else 1 / k) / scale) for x in range(-5, 6)]
    out = 0.0
    for x in range(-5, 6):
        if x:
            seen = counts[x + 5] / sum(counts)
            a, b = max(raw[x + 5] / sum(raw), 1e-4), max(seen, 1e-4)
            out += -10 * math.log10(min(a, b) / max(a, b)) * seen
    return out + (max(skew, 1 / skew) - 1) * 0.01 + ((scale - before) ** 2 if before is not None else 0)


def test_grid_loss_and_its_minimum_match_loops():
    scales, skews, _ = M.grid()
    assert scales[0] == 0.05 and scales[-1] <= 5.001 and 60 < len(scales) < 100
    counts = np.array([0, 1, 3, 20, 400, 9000, 300, 12, 1, 0, 0], float)
    for before in (None, 0.4):
        scale, skew, loss = M.fit_count(counts, before)
        every = {(a, b): plain_loss(counts, a, b, before) for a in scales[::3] for b in skews[::3]}
        assert loss == pytest.approx(plain_loss(counts, scale, skew, before)) and loss <= min(every.values()) + 1e-12


def simulated(scale, skew, n):
    return np.round(M.laplace(scale, skew) * n)


def test_parameters_are_recovered(spark):
    rows = []
    true = lambda n: 0.1 * n - 0.3
    for n in range(4, 16):
        for j, k in enumerate(simulated({4: 0.12, 5: 0.2, 6: 0.3}.get(n, true(n)), 1.2, 200_000)):
            rows.append(("s", "A", n, j - 5, int(k)))
    rows += [("s", "AC", 4, 0, 100), ("s", "AC", 4, -1, 3), ("t", "A", 4, 9, 5), ("t", "A", 40, 0, 5), ("t", None, 4, 0, 5)]
    reads = spark.createDataFrame(rows, "sample string, unit string, count int, jitter int, n long")
    got = {(r["sample"], r.unit): r for r in M.jitter_models(reads, ["sample"], "unit", "count", "jitter", "n").collect()}
    a = got["s", "A"]
    assert abs(a.scale4 - 0.12) <= 0.03 and abs(a.scale5 - 0.2) <= 0.03 and abs(a.scale6 - 0.3) <= 0.03
    assert abs(a.gradient - 0.1) < 0.02 and abs(a.gradient * 10 + a.intercept - true(10)) < 0.06 and abs(a.skew - 1.2) < 0.1
    b = got["s", "AC"]
    assert (b.scale4, b.scale5, b.scale6, b.gradient, b.skew) == (0.15, 0.2, 0.25, 0.06, 1.0) and b.intercept == pytest.approx(0.25 - 0.36)
    assert set(got) == {("s", "A"), ("s", "AC")}


def brute_bounded(a, b, most, steps=60):
    """The best x on a lattice."""
    top = b.sum()
    best = (float("inf"), None)
    for x in itertools.product(np.linspace(0, top, steps), repeat=a.shape[1]):
        y = a @ np.array(x)
        if (y <= most).all() and ((y - b) ** 2).sum() < best[0]:
            best = (((y - b) ** 2).sum(), x)
    return best[0]


def test_no_count_is_overshot_and_no_lattice_point_is_better():
    r = np.random.default_rng(3)
    for _ in range(25):
        a = r.dirichlet(np.full(7, 0.6), 2).T
        b = np.round(r.gamma(1.0, 30, 7))
        most = b + np.array([M.noise_of(int(v)) for v in b]) * 0.2
        x = M.bounded_fit(a, b, most)
        assert (x >= 0).all() and (a @ x <= most * (1 + 1e-6) + 1e-6).all()
        assert ((a @ x - b) ** 2).sum() <= brute_bounded(a, b, most) * (1 + 1e-3) + 1e-3


def test_refinement_keeps_the_planted_signatures():
    r = np.random.default_rng(5)
    a = r.dirichlet(np.full(30, 0.3), 8).T
    for planted in ([0], [2, 5], [1, 4, 7]):
        x = np.zeros(8)
        x[planted] = [1000, 700, 400][: len(planted)]
        b = r.poisson(a @ x).astype(float)
        got = M.refined(a, b)
        assert set(np.flatnonzero(got > 0.02 * b.sum())) == set(planted)
        most = b + np.array([M.noise_of(int(v)) for v in b])
        assert (a @ got <= most * (1 + 1e-6)).all()
        # Of all sets of as many signatures none has a smaller error by more than the loss that a drop may add.
        error = lambda keep: np.abs(b - a[:, keep] @ M.bounded_fit(a[:, keep], b, most)).sum() / b.sum()
        assert error(planted) <= min(error(list(k)) for k in itertools.combinations(range(8), len(planted))) + M.LOSS * 8
    assert (M.refined(a, np.zeros(30)) == 0).all()
    assert np.allclose(M.bounded_fit(a, b, b + 1e9), nnls(a, b))


def test_noise_bound():
    for n in (0, 3, 40):
        mean = n + M.noise_of(n)
        assert sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(n + 1)) == pytest.approx(M.NOISE, abs=1e-5)


def test_refined_signatures_in_spark(spark):
    signatures = {"x": {"a": 0.7, "b": 0.3}, "y": {"b": 0.2, "c": 0.8}, "z": {"a": 0.1, "d": 0.9}}
    rows = [(1, "a", 700), (1, "b", 300), (2, "c", 400), (2, "c", 400), (2, "b", 200), (3, "d", None), (3, "q", 5)]
    got = {(r["sample"], r.signature): r.allocation for r in M.refined_signatures(spark.createDataFrame(rows, "sample int, bucket string, n int"), "sample", "bucket", "n", signatures).collect()}
    assert len(got) == 9 and abs(got[1, "x"] - 1000) < 60 and got[1, "z"] == 0 and abs(got[2, "y"] - 1000) < 60 and max(got[3, s] for s in "xyz") < 8


def test_planted_signatures_are_discovered(spark):
    r = np.random.default_rng(11)
    true = r.dirichlet(np.full(24, 0.35), 3)
    rows = []
    for i in range(90):
        mix = r.dirichlet([0.25, 0.25, 0.25])
        for b, n in enumerate(r.poisson(3000 * (mix @ true))):
            if n:
                rows.append((i, f"b{b}", int(n)))
    profiles, given = M.discovered(spark.createDataFrame(rows, "sample int, bucket string, n long"), "sample", "bucket", "n")
    found = {}
    for x in profiles.collect():
        found.setdefault(x.signature, np.zeros(24))[int(x.bucket[1:])] = x.share
    assert 3 <= len(found) <= 8
    for t in true:
        assert max(t @ f / np.linalg.norm(t) / np.linalg.norm(f) for f in found.values()) >= 0.95
    total = {}
    for x in given.collect():
        total[x["sample"]] = total.get(x["sample"], 0) + x.allocation
    counts = {}
    for s, _, n in rows:
        counts[s] = counts.get(s, 0) + n
    assert sum(total.values()) >= 0.85 * sum(counts.values()) and all(total[s] <= counts[s] * 1.35 for s in total)


def test_empty(spark):
    empty = spark.createDataFrame([], "sample int, bucket string, n long")
    assert [x.count() for x in M.discovered(empty, "sample", "bucket", "n")] == [0, 0]
    assert M.refined_signatures(empty, "sample", "bucket", "n", {"x": {"a": 1.0}}).count() == 0

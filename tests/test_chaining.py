"""Chains by rules and copy numbers over hand-made clusters, invariants over random ones, and rings."""

import random
from collections import Counter

import pytest

from helixframe.operators import chaining as C

SCHEMA = "cluster int, variant long, chromosome_start string, position_start long, orientation_start int, chromosome_end string, position_end long, orientation_end int, copies double, spread double, beside_start double, beside_end double"


def sv(variant, a, b, copies=1.0, c1="1", c2="1", beside=(1.0, 1.0)):
    """a and b: positions whose sign is the orientation."""
    side = lambda c, p: (c, abs(p), 1 if p > 0 else -1) if p else (None, None, None)
    return (variant, *side(c1, a), *side(c2, b), float(copies), 0.0, *beside)


START, END = 0, 1
#: name: variants, assembled links, and (links, variants, copies) of each chain expected.
CASES = {
    "assembled": ([sv(0, 100, -200), sv(1, 300, -400), sv(2, 500, -600), sv(3, 700, -800)], [(0, END, 1, START), (1, END, 2, START), (2, END, 3, START)], [(3, 4, 1)]),
    "partly assembled": ([sv(0, 100, -200), sv(1, 300, -400), sv(2, 500, -600), sv(3, 700, -800)], [(1, END, 2, START)], [(3, 4, 1)]),
    "not closed": ([sv(1, -100, -200), sv(2, 300, -400), sv(3, 500, -600), sv(4, 700, 800)], [], [(3, 4, 1)]),
    "spanning assemblies": ([sv(i, 100 + 200 * i, -200 - 200 * i) for i in range(5)], [(0, END, 1, START), (1, END, 2, START), (2, END, 3, START), (3, END, 4, START), (0, END, 2, START), (2, END, 4, START)], [(4, 5, 1)]),
    "breakage cycles": ([sv(1, -1000, -2000, 8), sv(2, 9000, 10000, 4), sv(3, 6000, 7000, 2), sv(4, 3000, 4000, 1), sv(5, 12000, 100, 1, c2="2")], [], [(15, 5, 1)]),
    "breakage cycles, uneven": ([sv(1, -2000, -3000, 3), sv(2, 9000, 10000), sv(3, 5000, 6000), sv(4, 1000, 8000)], [], [(5, 4, 1)]),
    "chained foldbacks": ([sv(0, -2000, -5500, 4), sv(1, -3000, 5600, 4), sv(2, 9000, 10000, 2), sv(3, 5000, 6000), sv(4, 1000, 8000)], [(0, END, 1, END)], [(11, 5, 1)]),
    "two chained foldbacks": ([sv(1, -1000, -2000, 2), sv(2, 3000, 4000), sv(3, 6000, -7000, 4), sv(4, 9000, 10000, 2), sv(5, -5000, -15000), sv(6, 15500, 1000, c2="2")], [(1, START, 2, START), (1, START, 2, END), (3, END, 4, START), (3, END, 4, END)], [(10, 6, 1)]),
    "foldback and a chain of twice its copies": ([sv(1, -1000, -1000, c2="2"), sv(2, -6000, 3000, c2="2"), sv(3, 10000, -20000, 2, c2="2"), sv(4, -11000, 25000, 2, c2="2"), sv(5, 28000, 2000, c2="3")], [(1, END, 2, END), (3, END, 4, END)], [(6, 5, 1)]),
    "duplication of an assembled chain": ([sv(1, 2000, -3000, 2), sv(2, 4000, -100, 2, c2="2"), sv(3, -5000, 200, 2, c2="2"), sv(4, -1000, 6000)], [(1, END, 2, START), (2, END, 3, END)], [(6, 4, 1)]),
    "duplication of a variant": ([sv(1, 4000, -5000, 2), sv(2, -2000, 6000), sv(3, 7000, -8000), sv(4, 500, -100, c2="2"), sv(5, -1000, 200, c2="2")], [], [(5, 5, 1)]),
    "duplication of a chain": ([sv(1, 1000, 5000), sv(2, -4000, 9000, 2), sv(3, 7000, -8000, 2), sv(4, 3000, -6000, 2), sv(5, -2000, -10000), sv(6, -2500, 4500)], [], [(8, 6, 1)]),
    "single breakends": ([sv(3, 40000, -100, 4, c2="2"), sv(4, -40000, 0, 4), sv(5, -44000, 200, 4, c2="2"), sv(6, 45000, 0, 4)], [], [(2, 3, 4), (0, 1, 4)]),
    "nothing faces": ([sv(1, -100, 50), sv(2, 10, -900)], [], [(0, 1, 1), (0, 1, 1)]),
    "alone": ([sv(7, 100, -200, 3)], [], [(0, 1, 3)]),
}


def tables(spark, cases):
    rows = [(i, *v) for i, (variants, _, _) in enumerate(cases) for v in variants]
    links = [(i, *x) for i, (_, links, _) in enumerate(cases) for x in links]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(links, "cluster int, a_variant long, a_side int, b_variant long, b_side int")


def test_hand_made_clusters(spark):
    variants, links = tables(spark, CASES.values())
    got = {}
    for r in C.chains(variants, ["cluster"], links).orderBy("cluster", "chain").collect():
        got.setdefault(r.cluster, []).append((r.links, r.variants, round(r.copies, 2)))
    for i, (name, (_, _, want)) in enumerate(CASES.items()):
        if name == "single breakends":  # a base between the two ends at one place is too short a segment
            assert sum(x[0] for x in got[i]) == 2, (name, got[i])
        else:
            assert got[i] == want, (name, got[i])


def random_cluster(r, n):
    out = []
    for v in range(n):
        a, b = r.choice([1, -1]) * r.randrange(1, 5000), r.choice([1, -1, 0]) * r.randrange(1, 5000)
        out.append(sv(v, a, b, r.choice([1, 1, 2, 4]), r.choice("12"), r.choice("12")))
    return out


def test_copies_are_kept_and_links_face(spark):
    r = random.Random(4)
    cases = [(random_cluster(r, r.randrange(1, 14)), [], None) for _ in range(60)]
    variants, links = tables(spark, cases)
    chained, linked = C.chains(variants, ["cluster"], links).collect(), C.chain_links(variants, ["cluster"], links).collect()
    for i, (rows, _, _) in enumerate(cases):
        ends = {(v[0], s): (v[1 + 3 * s], v[2 + 3 * s], v[3 + 3 * s]) for v in rows for s in (0, 1) if v[1 + 3 * s] is not None}
        used = Counter()
        own = [x for x in chained if x.cluster == i]
        for c in own:
            for step in c.path.split(","):
                used[abs(int(step))] += c.copies
        for v in rows:
            assert used[v[0]] == pytest.approx(v[7], abs=0.5 * len(rows) ** 0.5 + 0.15 * v[7])
        for x in (x for x in linked if x.cluster == i):
            a, b = ends[x.a_variant, x.a_side], ends[x.b_variant, x.b_side]
            low, high = sorted((a, b), key=lambda e: (e[1], -e[2]))
            assert a[0] == b[0] and low[2] == -1 and high[2] == 1 and high[1] - low[1] >= 30
        # No two chains are left that could be joined.
        open_ends = []
        for c in own:
            steps = [(abs(int(s)), 1 if s.startswith("-") else 0) for s in c.path.split(",")]
            open_ends.append([e for e in ((steps[0][0], steps[0][1]), (steps[-1][0], 1 - steps[-1][1])) if e in ends])
        for k, x in enumerate(open_ends):
            for y in open_ends[k + 1 :]:
                for a in x:
                    for b in y:
                        p, q = (C.End(*e, *ends[e]) for e in (a, b))
                        assert not C.faces(p, q)


def test_result_follows_from_the_rows_alone(spark):
    r = random.Random(6)
    cases = [(random_cluster(r, 9), [], None) for _ in range(10)]
    variants, links = tables(spark, cases)
    one = sorted(map(tuple, C.chains(variants, ["cluster"], links).collect()))
    assert one == sorted(map(tuple, C.chains(variants.repartition(7).orderBy("copies"), ["cluster"]).collect()))


def test_rings(spark):
    rows = [
        (0, *sv(1, -1000, 9000, 10)),  # a duplication
        (1, *sv(1, -1000, 9000, 10, beside=(9.0, 1.0))),  # not beyond both sides
        (2, *sv(1, -1000, 5000, 12, c2="2")), (2, *sv(2, 9000, -2000, 11, c2="2")),  # two translocations
        (3, *sv(1, -1000, 5000, 12, c2="2")), (3, *sv(2, 9000, -2000, 11, c2="3")),  # open
        (4, *sv(1, -1000, 9000, 6)),  # too few copies
        (5, *sv(1, -1000, 2000, 10)),  # too short
        (6, *sv(1, -1000, 5000, 12, c2="2")), (6, *sv(2, 9000, -2000, 11, c2="2")), (6, *sv(3, -100, 20_000, 1)),  # a low variant around it
        (7, *sv(1, -1000, 9000, 10, beside=(None, None))),
    ]
    got = {r.cluster: (r.links, r.variants, r.length, round(r.copies, 1)) for r in C.rings(spark.createDataFrame(rows, SCHEMA), ["cluster"]).collect()}
    assert got == {0: (1, 1, 8000, 10.0), 2: (2, 2, 11000, 11.5), 6: (2, 2, 11000, 11.5), 7: (1, 1, 8000, 10.0)}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.chains(empty, ["cluster"]).count() == 0 and C.rings(empty, ["cluster"]).count() == 0

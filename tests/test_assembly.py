"""Tolerant comparison against a full dynamic programme; assembly of planted junctions."""

import random

import numpy as np
import pytest

from helixframe.operators import assembly as A


def cost(q, medium):
    return A.LOW if q <= A.LOW_QUALITY else medium if q <= A.MEDIUM_QUALITY else A.HIGH


def copies(s, end, unit):
    """Whole copies of the last ``unit`` bases before ``end``."""
    n = 1
    while end - (n + 1) * unit >= 0 and s[end - (n + 1) * unit : end - n * unit] == s[end - unit : end]:
        n += 1
    return n


def full(a, qa, b, qb):
    """The whole table, without a band."""

    def gap(q, i, n, other, j):
        return cost(min([*q[i - n : i], *other[j : j + 1]]), A.MEDIUM_GAP)

    best, overlap, table = float("inf"), 0, {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = [0.0] if i == j == 0 else []
            if i and j:
                options.append(table[i - 1, j - 1] + (0 if a[i - 1] == b[j - 1] else cost(min(qa[i - 1], qb[j - 1]), A.MEDIUM_BASE)))
            options += [table[i - n, j] + gap(qa, i, n, qb, j) for n in (1, 2) if i >= n]
            options += [table[i, j - n] + gap(qb, j, n, qa, i) for n in (1, 2) if j >= n]
            for u in (1, 2, 3):
                if i >= u and j >= u and a[i - u : i] == b[j - u : j]:
                    x, y = copies(a, i, u), copies(b, j, u)
                    most = max([m for c, m in A.MISSING if max(x, y) >= c], default=0)
                    n = abs(x - y)
                    if 0 < n <= most:
                        options.append(table[i - n * u, j] + gap(qa, i, n * u, qb, j) if x > y else table[i, j - n * u] + gap(qb, j, n * u, qa, i))
            table[i, j] = min(options, default=float("inf"))
            if (i == len(a) or j == len(b)) and (table[i, j] < best - 1e-12 or (abs(table[i, j] - best) <= 1e-12 and min(i, j) > overlap)):
                best, overlap = table[i, j], min(i, j)
    return best, overlap


def random_pair(r):
    a = bytes(r.choice(b"ACGT") for _ in range(r.randrange(0, 25)))
    for _ in range(r.randrange(3)):
        unit = bytes(r.choice(b"ACGT") for _ in range(r.randrange(1, 4)))
        a += unit * r.randrange(2, 18) + bytes(r.choice(b"ACGT") for _ in range(r.randrange(5)))
    b = bytearray(a)
    for _ in range(r.randrange(5)):
        k = r.randrange(len(b) + 1)
        kind = r.randrange(3)
        if kind == 0 and k < len(b):
            b[k] = r.choice(b"ACGT")
        elif kind == 1:
            del b[k : k + r.randrange(1, 6)]
        else:
            b[k:k] = bytes(r.choice(b"ACGT") for _ in range(r.randrange(1, 3)))
    b = bytes(b)
    q = lambda n: bytes(r.choice([20, 28, 37]) for _ in range(n))
    return a, q(len(a)), b, q(len(b))


def test_equals_the_full_table():
    r = random.Random(1)
    pairs = [random_pair(r) for _ in range(250)]
    penalty, overlap = A.penalties(*map(list, zip(*pairs)), band=80)
    for k, p in enumerate(pairs):
        want = full(*p)
        assert np.isclose(penalty[k], want[0]) and overlap[k] == want[1], (p, penalty[k], overlap[k], want)


def test_repeats_and_quality():
    q = lambda s, v=40: bytes([v] * len(s))
    of = lambda a, b, v=40: float(A.penalties([a], [q(a, v)], [b], [q(b, v)])[0][0])
    flank = b"GCTAGCTTGACCATGC"
    assert of(flank + b"A" * 16 + flank, flank + b"A" * 13 + flank) == 1.0  # three copies of a long run
    assert of(flank + b"CT" * 12 + flank, flank + b"CT" * 10 + flank) == 1.0
    assert of(flank + flank, flank[:8] + b"T" + flank[9:] + flank) == 1.0
    assert of(flank + flank, flank[:8] + b"T" + flank[9:] + flank, 28) == A.MEDIUM_BASE
    assert of(flank + flank, flank[:8] + b"T" + flank[9:] + flank, 10) == 0.0
    assert A.permitted([5, 6, 15, 16, 49, 99, 100]).tolist() == [0, 0.3, 0.3, 1, 1, 2, 3]


def test_compared_in_spark(spark):
    r = random.Random(2)
    text = lambda q: "".join(chr(33 + x) for x in q)
    pairs = [random_pair(r) for _ in range(60)]
    rows = [(i, a.decode(), text(qa), b.decode(), text(qb), i) for i, (a, qa, b, qb) in enumerate(pairs)] + [(60, None, None, "ACG", "III", 1), (61, "", "", "", "", 2)]
    got = {x.id: x for x in A.compared(spark.createDataFrame(rows, "id int, a string, qa string, b string, qb string, overlapping int"), "a", "qa", "b", "qb", 80).collect()}
    for i, p in enumerate(pairs):
        penalty, overlap = full(*p)
        assert np.isclose(got[i].penalty, penalty) and got[i].overlap == overlap and got[i].alike == (penalty <= A.permitted(overlap))
    assert (got[60].penalty, got[60].overlap, got[60].alike) == (0, 0, True) == (got[61].penalty, got[61].overlap, got[61].alike)


def sequence(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def cut_reads(r, junction, text, at, n, fragments, errors=0.004, length=100):
    """Reads over place ``at`` of a text, with errors of low quality and a few of high."""
    out = []
    for i in range(n):
        start = at - r.randrange(20, length - 20)
        bases = list(text[start : start + length])
        quality = ["I"] * length
        for k in range(length):
            if r.random() < 0.03:
                bases[k], quality[k] = r.choice("ACGT"), "+"
            elif r.random() < errors:
                bases[k] = r.choice("ACGT")
        out.append((junction, f"j{junction}r{i}", f"f{fragments}{i}", "".join(bases), "".join(quality), at - start))
    return out


SCHEMA = "junction long, read string, fragment string, bases string, qualities string, at int"


def test_planted_junctions_are_rebuilt(spark):
    r = random.Random(5)
    planted, rows = {}, []
    for j in range(6):
        text = sequence(r, 400)
        planted[j] = text
        rows += cut_reads(r, j, text, 200, 20, f"x{j}_")
    # Two alleles behind one junction, a deep junction, one without anchors, and one with a read only.
    twice = [sequence(r, 200) + sequence(r, 200)]
    twice.append(twice[0][:230] + sequence(r, 170))
    for k, t in enumerate(twice):
        rows += [(6, f"{k}{x[1]}", *x[2:]) for x in cut_reads(r, 6, t, 200, 12 + 4 * k, f"y{k}_")]
    planted[7] = sequence(r, 400)
    rows += cut_reads(r, 7, planted[7], 200, 400, "deep")
    rows += [(8, "a", "f", "ACGTACGTAC" * 4, "I" * 40, 35), (8, "b", "g", "ACGTACGTAC" * 4, "I" * 40, 35), (9, "c", "h", "ACGTACGTAC" * 10, "I" * 100, 50), (9, "d", "h", None, None, 50)]
    made = A.assembled(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {m.junction for m in made} == {0, 1, 2, 3, 4, 5, 6, 7}
    for m in made:
        if m.junction != 6:
            at = planted[m.junction].find(m.sequence)
            assert at >= 0 and at + m.junction_at == 200 and len(m.sequence) > 100
            assert m.branch == "" and m.support >= 0.9 * (400 if m.junction == 7 else 20)
    six = [m for m in made if m.junction == 6]
    assert len(six) == 2
    assert {k for m in six for k, t in enumerate(twice) if t[200 : 200 + 60] == m.sequence[m.junction_at :][:60]} == {0, 1}
    assert sum(m.support for m in six) == 28 and min(m.support for m in six) >= 9  # a few reads end before the alleles part, and stay with the first


def test_votes_match_plain_counting(spark):
    r = random.Random(8)
    rows = cut_reads(r, 1, sequence(r, 400), 200, 9, "v", errors=0.05) + cut_reads(r, 2, sequence(r, 400), 200, 5, "w", errors=0.05)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'' AS branch")
    got = {m.junction: m for m in A.consensus(docs).collect()}
    for j in (1, 2):
        votes = {}
        for x in rows:
            if x[0] == j:
                for i, (c, q) in enumerate(zip(x[3], x[4])):
                    votes.setdefault(i - x[5], {}).setdefault(c, []).append(ord(q) - 33)
        ok = {o: max(v, key=lambda c: (sum(v[c]), -ord(c))) for o, v in votes.items() if sum(map(len, v.values())) >= 2}
        hi = lo = 0
        while hi in ok:
            hi += 1
        while lo - 1 in ok:
            lo -= 1
        assert got[j].sequence == "".join(ok[o] for o in range(lo, hi)) and got[j].junction_at == -lo


def test_phase_groups_and_links(spark):
    r = random.Random(9)
    whole = sequence(r, 600)
    turned = whole.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    other = sequence(r, 300)
    rows = [(1, whole[:300]), (2, whole[220:520]), (3, turned[100:400]), (4, other), (5, other[200:] + sequence(r, 100))]
    assemblies = spark.createDataFrame([(f"a{j}", j, s, "I" * len(s)) for j, s in rows], "id string, junction long, sequence string, qualities string")
    pairs = {1: "ab", 2: "abcd", 3: "cd", 4: "e", 5: "ef", 6: "g"}
    reads = spark.createDataFrame([(j, f) for j, fs in pairs.items() for f in fs], "junction long, fragment string")
    groups = A.phase_groups(reads)
    assert {x.junction: x.group for x in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    got = {(x.a, x.b): (x.turned, x.overlap) for x in A.linked(assemblies, groups).collect()}
    # turned[100:400] is whole[200:500] read backwards; a4 and a5 overlap but share one fragment only.
    assert got == {("a1", "a2"): (False, 80), ("a1", "a3"): (True, 100), ("a2", "a3"): (True, 280)}


def test_nearest_known_and_seeds(spark):
    r = random.Random(11)
    known = [(f"v{i}", i % 2, "c1", r.randrange(3000), r.choice([1, -1])) for i in range(150)]
    ends = [("c1", r.randrange(3200), r.choice([1, -1]), i) for i in range(200)] + [("c2", 5, 1, 900)]
    ends.append(ends[0])
    got = A.nearest_known(spark.createDataFrame(ends, "chromosome string, position long, orientation int, id int"), spark.createDataFrame(known, "variant string, breakend int, chromosome string, position long, orientation int"), 20).collect()
    assert len(got) == len(ends)
    for x in got:
        near = [(abs(p - x.position), o != x.orientation, v, b) for v, b, c, p, o in known if c == x.chromosome and abs(p - x.position) <= 20]
        want = min(near, default=None)
        assert (x.variant, x.breakend, x.distance) == ((want[2], want[3], want[0]) if want else (None, None, None))
    s = sequence(r, 200)
    a = spark.createDataFrame([("r1", s[50:150]), ("r2", sequence(r, 100)), ("r3", "ACG")], "id string, q string")
    b = spark.createDataFrame([("k1", s), ("k2", sequence(r, 200))], "k string, s string")
    assert [tuple(x) for x in A.seeded(a, b, "id", "q", "k", "s").collect()] == [("r1", "k1", 50, 4)]


@pytest.mark.parametrize("rows", [[], [(1, "r", "f", None, None, 0)]])
def test_no_reads(spark, rows):
    assert A.assembled(spark.createDataFrame(rows, SCHEMA)).count() == 0

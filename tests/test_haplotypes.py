"""Phased evidence against plain counting, planted haplotypes, and the alleles that they leave."""

import random
from collections import Counter

from helixframe.operators import haplotypes as H


def made(r, haplotypes, loci, fragments, reach, errors=0.0):
    rows = []
    for i in range(fragments):
        h = r.choice(haplotypes)
        start = r.randrange(len(loci))
        for k in range(start, min(len(loci), start + r.randrange(1, reach + 1))):
            rows.append((f"f{i}", loci[k], r.choice("ACDE") if r.random() < errors else h[k]))
    return rows


def tables(spark, by_gene):
    fragments = [(g, *x) for g, (rows, _) in by_gene.items() for x in rows]
    evidence = [(g, locus, letter) for g, (_, support) in by_gene.items() for locus, letters in support.items() for letter in letters]
    return spark.createDataFrame(fragments, "gene string, fragment string, locus int, letter string"), spark.createDataFrame(evidence, "gene string, locus int, letter string")


def test_pairs_match_plain_counting(spark):
    r = random.Random(1)
    loci = [3, 9, 10, 40, 55]
    rows = made(r, ["AACDA", "CADDA", "CECAE"], loci, 300, 4, 0.1)
    rows += [("f0", 3, "A"), ("f0", 3, "C")]
    support = {3: "AC", 9: "AE", 10: "CD", 40: "DA", 55: "A"}
    fragments, evidence = tables(spark, {"g": (rows, support)})
    held = {}
    for f, locus, letter in rows:
        if len(support[locus]) > 1 and letter in support[locus]:
            held.setdefault(f, {}).setdefault(locus, set()).add(letter)
    want = Counter()
    for own in held.values():
        one = {k: next(iter(v)) for k, v in own.items() if len(v) == 1}
        for a, b in ((3, 9), (9, 10), (10, 40)):
            if a in one and b in one:
                want[a, b, one[a], one[b]] += 1
    assert {(x.locus, x.next, x.a, x.b): x.n for x in H.phased_pairs(fragments, evidence, ["gene"]).collect()} == dict(want)


def test_planted_haplotypes(spark):
    r = random.Random(2)
    loci = list(range(0, 120, 10))
    two = ["".join(r.choice("AC") for _ in loci)]
    two.append(two[0].translate(str.maketrans("AC", "CA")))
    three = [two[0], two[1], two[0][:6] + two[1][6:]]
    gap = ["AAAACCCC", "CCCCAAAA"]
    rows = {"two": (made(r, two, loci, 2000, 4), dict.fromkeys(loci, "AC")), "three": (made(r, three, loci, 3000, 5), dict.fromkeys(loci, "AC"))}
    held = [x for x in made(r, gap, loci[:8], 1500, 3) if True]
    cut = {}
    for f, locus, letter in held:
        cut.setdefault(f, []).append((locus, letter))
    broken = [(f, *x) for f, own in cut.items() for x in own if not (min(o for o, _ in own) <= 30 < max(o for o, _ in own))]
    rows["gap"] = (broken, dict.fromkeys(loci[:8], "AC"))
    rows["few"] = ([("a", 0, "A"), ("a", 10, "C")], {0: "AC", 10: "AC"})
    rows["one"] = ([("a", 0, "A")], {0: "AC", 10: "A"})
    fragments, evidence = tables(spark, rows)
    got = {}
    for x in H.phased_haplotypes(fragments, evidence, ["gene"]).collect():
        got.setdefault(x.gene, {}).setdefault((x.first, x.last), set()).add(x.haplotype)
        assert len(x.loci) == len(x.haplotype)
    assert got["two"] == {(0, 110): set(two)}
    assert got["gap"] == {(0, 30): {"AAAA", "CCCC"}, (40, 70): {"CCCC", "AAAA"}}
    assert set(got) == {"two", "three", "gap"}
    for (lo, hi), haplotypes in got["three"].items():
        a, b = lo // 10, hi // 10 + 1
        assert haplotypes == {h[a:b] for h in three}


def test_bridges_need_what_tells_combinations_apart():
    # Middle places that are alike in two of three combinations: the tail must reach over them.
    patterns = [("AAC.", 20), ("CAC.", 20), ("CCA.", 20), (".ACA", 30), (".CAC", 30)]
    found = H.combined(patterns, 4, [set("AC"), set("AC"), set("AC"), set("AC")], 14)
    assert [(e.lo, e.hi, sorted(e.counts)) for e in found] in ([(0, 3, ["AACA", "CACA", "CCAC"])], [(0, 2, ["AAC", "CAC", "CCA"]), (2, 3, ["AC", "CA"])])
    # A combination that is seen once among many is an error.
    assert sorted(H._seen([("AC", 50), ("CA", 40), ("AA", 1)], 0, 1, 40).counts) == ["AC", "CA"]
    assert sorted(H._seen([("AC", 5), ("CA", 4), ("AA", 1)], 0, 1, 40).counts) == ["AA", "AC", "CA"]


def test_alleles_that_agree(spark):
    haplotypes = spark.createDataFrame([("g", 0, 20, [0, 10, 20], "ACA", 9), ("g", 0, 20, [0, 10, 20], "CAC", 8), ("g", 50, 60, [50, 60], "AA", 9), ("g", 50, 60, [50, 60], "CC", 9)], "gene string, first int, last int, loci array<int>, haplotype string, n long")
    letters = {"a1": "ACAAA", "a2": "CACCC", "a3": "CAAAA", "a4": "A*AAA", "a5": "ACAAC", "a6": "ACA"}
    rows = [(a, "g", locus, x) for a, s in letters.items() for locus, x in zip((0, 10, 20, 50, 60), s)] + [("b1", "h", 0, "A")]
    got = {(x.gene, x.allele) for x in H.agreeing_alleles(spark.createDataFrame(rows, "allele string, gene string, locus int, letter string"), haplotypes, ["gene"]).collect()}
    assert got == {("g", "a1"), ("g", "a2"), ("g", "a4"), ("h", "b1")}

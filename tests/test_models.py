"""Operators without SQL against plain Python."""

import random

import numpy as np
import pytest

from helixframe.functions.stats import binomial_cdf_one
from helixframe.operators import features as X
from helixframe.operators import fragments as R
from helixframe.operators import impact as E
from helixframe.operators import purityfit as P
from helixframe.operators import receptors as Z


def test_chains_take_the_shortest_links_first(spark):
    rng = random.Random(3)
    ends = [(i, i // 2) for i in range(80)]
    links = [(a, b, rng.randrange(40)) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(90)) if a != b]
    root = list(range(80))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def tie(a, b):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)

    for v in range(40):
        tie(2 * v, 2 * v + 1)
    used = set()
    for n, a, b in sorted((n, min(a, b), max(a, b)) for a, b, n in links):
        if a not in used and b not in used:
            used |= {a, b}
            tie(a, b)
    got = R.chains(spark.createDataFrame(links, "a long, b long, length long"), spark.createDataFrame(ends, "breakend long, variant long")).collect()
    assert {r.breakend: r.chain for r in got} == {i: find(i) for i in range(80)}


def test_readjusted_purity(spark):
    rng = np.random.default_rng(2)
    rows = [(60, int(rng.binomial(60, 0.25))) for _ in range(400)]
    df = spark.createDataFrame(rows, "n long, k long")

    def brute(standard):
        found = []
        test = standard
        top = min(2 * max(k / n for n, k in rows), 1)
        while test < top - 1e-12:
            p = sorted(1 - binomial_cdf_one(k - 1, n, test / 2) if k > n * test / 2 else 1.0 for n, k in rows)
            limit = max(p[4], 0.005)
            expected = sum(k / n >= test / 2 for n, k in rows) * limit / 0.5
            if sum(x <= limit for x in p) <= expected:
                found.append(round(test, 9))
            test += 0.005
        return min(found, default=None)

    assert P.readjusted_purity(df, 0.3) == pytest.approx(brute(0.3))
    assert P.readjusted_purity(df.limit(3), 0.3) is None


def test_subclonal_peaks_find_both_clones(spark):
    rng = np.random.default_rng(5)
    rows = [("s", float(v), 80.0, 2.0) for v in np.concatenate([rng.normal(1.0, 0.06, 3000), rng.normal(0.4, 0.05, 800)])]
    got = P.subclonal_peaks(spark.createDataFrame(rows, "s string, copies double, depth double, purity_copies double"), ["s"]).collect()
    first = min(got, key=lambda r: r["round"])
    assert abs(first.peak - 1.0) < 0.06 and not first.subclonal
    assert any(r.subclonal and abs(r.peak - 0.4) < 0.08 for r in got)
    assert sum(r.weight for r in got) <= len(rows) + 1e-6


def test_expected_baf_and_simulated_counts(spark):
    assert P.expected_baf(30) > P.expected_baf(100) >= P.AMBIGUOUS
    rates = spark.createDataFrame([("a", 3.0), ("b", 40.0), ("c", 0.0)], "bucket string, mean double")
    rows = X.simulated(rates, 400, 7).collect()
    for bucket, mean in (("a", 3.0), ("b", 40.0), ("c", 0.0)):
        n = [r.n for r in rows if r.bucket == bucket]
        assert len(n) == 400 and np.mean(n) == pytest.approx(mean, abs=0.2 + mean * 0.04) and np.var(n) == pytest.approx(mean, rel=0.35, abs=0.1)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, X.simulated(rates, 400, 7).collect()))


def test_effects_of_hand_made_variants(spark):
    """One forward gene: exons 101-160 and 201-260, coding 111-250; ATG at 111."""
    coding = "ATGAAACCCGGGTTTACGACTTGGCCATAA" + "ACGTTG" * 20
    t = spark.createDataFrame([("T", "G", "1", 1, 101, 260, 111, 250)], "transcript string, gene string, chromosome string, strand int, trans_start long, trans_end long, coding_start long, coding_end long")
    e = spark.createDataFrame([("T", 101, 160), ("T", 201, 260)], "transcript string, exon_start long, exon_end long")
    q = spark.createDataFrame([("T", coding)], "transcript string, bases string")
    cases = [("start", 112, "T", "C", ["start_lost"]), ("mis", 114, "A", "C", ["missense"]), ("syn", 116, "A", "G", ["synonymous"]), ("stop", 134, "G", "A", ["stop_gained"]), ("utr", 105, "A", "C", ["five_prime_utr"]), ("utr3", 255, "A", "C", ["three_prime_utr"])]
    cases += [("donor", 161, "G", "A", ["splice_donor", "intronic"]), ("acceptor", 199, "A", "G", ["splice_acceptor", "intronic"]), ("intron", 180, "A", "G", ["intronic"]), ("up", 60, "A", "G", ["upstream_gene"]), ("frame", 120, "A", "", ["frameshift"]), ("in", 120, "ACC", "", ["inframe_deletion"])]
    v = spark.createDataFrame([(i, "1", p, r, a, None) for i, p, r, a, _ in cases], "id string, chromosome string, position long, ref string, alt string, lps long")
    got = {r.id: r for r in E.effects(v, t, e, q, 64).collect()}
    for i, _, _, _, want in cases:
        assert got[i].effects == want, (i, got[i])
    assert got["stop"].coding_effect == "NONSENSE_OR_FRAMESHIFT" and got["donor"].splice_region and not got["intron"].splice_region
    two = spark.createDataFrame([("a", "1", 120, "A", "", 5), ("b", "1", 126, "AC", "", 5), ("c", "1", 114, "A", "C", 5), ("d", "1", 115, "A", "C", 5)], "id string, chromosome string, position long, ref string, alt string, lps long")
    assert {r.id: r.phased for r in E.phased(E.effects(two, t, e, q, 64)).collect()} == {"a": "phased_inframe_deletion", "b": "phased_inframe_deletion", "c": "phased_missense", "d": "phased_missense"}


def test_matrix_files_and_similarity(spark, tmp_path):
    (tmp_path / "m").write_text("# comment\n   A  R  N\nA  4 -1 -2\nR -1  5  0\nN -2  0  6\n")
    m = Z.substitution_matrix(spark, str(tmp_path / "m"))
    assert m["R"] == {"A": -1, "R": 5, "N": 0}
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("ARN", "ARN"), ("ARN", "NRA"), ("AR", "ARN"), ("ARN", "ARX")], "a string, b string").select(Z.similarity(F.col("a"), F.col("b"), m).alias("s")).collect()
    assert [r.s for r in row] == [3, 3 + (-2 - 4) + 0 + (-2 - 6), None, None]

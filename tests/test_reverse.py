"""Variants behind protein changes against enumerating the genome; residues across fusions by hand."""

import random

import pytest

from helixframe.functions.sequences import CODONS
from helixframe.operators import reverse as R

TURN = str.maketrans("ACGT", "TGCA")
T = "transcript string, gene string, chromosome string, strand int, trans_start long, trans_end long, coding_start long, coding_end long"


class Gene:
    """A transcript of three exons on a random genome."""

    def __init__(self, name, strand, seed):
        r = random.Random(seed)
        self.name, self.strand = name, strand
        self.exons = [(100, 130), (150, 170), (200, 240)]
        self.start, self.end = 110, 228  # 21 + 21 + 29 = 71 bases; the last codon is whole with 72
        self.end = 229
        self.genome = [r.choice("ACGT") for _ in range(300)]
        self.places = [p for a, b in self.exons for p in range(max(a, self.start), min(b, self.end) + 1)]
        if strand < 0:
            self.places = self.places[::-1]
        assert len(self.places) % 3 == 0

    def bases(self, genome=None):
        s = "".join((genome or self.genome)[p] for p in self.places)
        return s if self.strand > 0 else s.translate(TURN)

    def rows(self):
        return (self.name, "g", "c", self.strand, 100, 240, self.start, self.end), [(self.name, a, b) for a, b in self.exons], (self.name, self.bases())


def protein(s):
    return "".join(CODONS[s[i : i + 3]] for i in range(0, len(s) - 2, 3))


@pytest.fixture(scope="module")
def genes(spark):
    genes = [Gene("p", 1, 3), Gene("m", -1, 4)]
    t, e, c = zip(*[g.rows() for g in genes])
    t = [*t, ("none", "g", "c", 1, 1, 9, None, None)]
    return {g.name: g for g in genes}, spark.createDataFrame(t, T), spark.createDataFrame([x for own in e for x in own], "transcript string, exon_start long, exon_end long"), spark.createDataFrame(c, "transcript string, bases string")


def test_substitutions_are_all_there_and_give_back_their_description(spark, genes):
    by_name, t, e, c = genes
    r = random.Random(1)
    changes, want = [], {}
    for g in by_name.values():
        aa = protein(g.bases())
        for k, ref in enumerate(aa):
            alt = r.choice([x for x in "ACDEFGHIKLMNPQRSTVWY*=" if x != ref])
            changes.append((f"{g.name}{k}", g.name, f"p.{ref}{k + 1}{alt}"))
            new = aa[:k] + (ref if alt == "=" else alt) + aa[k + 1 :]
            # Every block of up to three neighbouring coding bases of the codon, on the genome.
            own = set()
            codon = g.places[3 * k : 3 * k + 3]
            for i in range(3):
                for j in range(i, 3):
                    block = codon[i : j + 1]
                    if max(block) - min(block) != j - i:
                        continue
                    for code in range(4 ** len(block)):
                        alts = ["ACGT"[code // 4**x % 4] for x in range(len(block))]
                        lo = min(block)
                        olds = [g.genome[lo + x] for x in range(len(block))]
                        if alts[0] == olds[0] or alts[-1] == olds[-1]:
                            continue
                        genome = list(g.genome)
                        genome[lo : lo + len(block)] = alts
                        if protein(g.bases(genome)) == new:
                            own.add((lo, "".join(olds), "".join(alts)))
            want[f"{g.name}{k}"] = own
    got = {}
    for x in R.variants_behind(spark.createDataFrame(changes, "id string, transcript string, protein string"), t, e, c).collect():
        assert (x.position, x.ref, x.alt) not in got.setdefault(x.id, set())
        got[x.id].add((x.position, x.ref, x.alt))
    assert {k: v for k, v in want.items() if v} == got
    assert sum(map(len, got.values())) > 60


def test_losses_and_duplications(spark, genes):
    by_name, t, e, c = genes
    changes, want = [], {}
    for g in by_name.values():
        s = g.bases()
        aa = protein(s)
        for k in range(1, len(aa) - 2):
            for n in (1, 2):
                last = "" if n == 1 else f"_{aa[k + n - 1]}{k + n}"
                changes.append((f"{g.name}{k}d{n}", g.name, f"p.{aa[k]}{k + 1}{last}del"))
                changes.append((f"{g.name}{k}u{n}", g.name, f"p.{aa[k]}{k + 1}{last}dup"))
                own = set()
                for at in range(3 * k - 2, 3 * k + 3):
                    block = g.places[at : at + 3 * n]
                    if at >= 0 and len(block) == 3 * n and max(block) - min(block) == 3 * n - 1 and protein(s[:at] + s[at + 3 * n :]) == aa[:k] + aa[k + n :]:
                        own.add((min(block), "".join(g.genome[min(block) : max(block) + 1]), ""))
                if own:
                    want[f"{g.name}{k}d{n}"] = own
                end = 3 * (k + n)
                place = g.places[end - 1] if g.strand > 0 else g.places[end - 1] - 1
                more = s[3 * k : end]
                want[f"{g.name}{k}u{n}"] = {(place, "", more if g.strand > 0 else more.translate(TURN)[::-1])}
    got = {}
    for x in R.variants_behind(spark.createDataFrame(changes, "id string, transcript string, protein string"), t, e, c).collect():
        got.setdefault(x.id, set()).add((x.position, x.ref, x.alt))
    assert got == want


def test_descriptions_that_have_no_variant(spark, genes):
    by_name, t, e, c = genes
    aa = protein(by_name["p"].bases())
    wrong = "W" if aa[0] != "W" else "C"
    rows = [("a", "p", f"p.{wrong}1K"), ("b", "p", "p.K999L"), ("c", "none", "p.K1L"), ("d", "gone", "p.K1L"), ("e", "p", "c.5A>G"), ("f", "p", None), ("g", "p", "p.K2fs"), ("h", "p", f"p.{aa[0]}0K")]
    assert R.variants_behind(spark.createDataFrame(rows, "id string, transcript string, protein string"), t, e, c).count() == 0
    three = {v: k for k, v in R.RESIDUES.items()}
    pair = spark.createDataFrame([(1, f"p.{aa[3]}4Y"), (2, f"p.{three[aa[3]]}4Tyr"), (3, f"p.{three[aa[3]]}4_{three[aa[4]]}5del"), (4, "p.Ter4=")], "k int, protein string").orderBy("k")
    got = [tuple(x.p) for x in pair.select(R.parsed(pair["protein"]).alias("p")).collect()]
    assert got == [("sub", 4, 4, aa[3], "Y"), ("sub", 4, 4, aa[3], "Y"), ("del", 4, 5, aa[3], None), ("sub", 4, 4, "*", "*")]


def test_fusions(spark, genes):
    by_name, t, e, c = genes
    r = random.Random(6)
    rows, want = [], {}
    for i in range(120):
        a, b = (by_name[r.choice("pm")] for _ in "ab")
        x, y = r.randrange(95, 245), r.randrange(95, 245)
        insert = r.choice([None, "", "A", "GC", "ACG", "TTTT"])
        rows.append((i, a.name, x, b.name, y, insert))
        head = "".join(s for p, s in zip(a.places, a.bases()) if (p <= x if a.strand > 0 else p >= x))
        tail = "".join(s for p, s in zip(b.places, b.bases()) if (p >= y if b.strand > 0 else p <= y))
        n = len(head) + len(insert or "")
        frame = bool(head) and bool(tail) and (n - (len(b.places) - len(tail))) % 3 == 0
        whole = protein(head + (insert or "") + tail)
        read = whole.split("*")[0]
        lo = len(head) // 3
        hi = -(-n // 3) if frame else len(read)
        want[i] = (frame, read[max(0, lo - 4) : lo], read[lo : max(lo, hi)], read[hi : hi + 4] if frame else "", "*" in whole)
    rows.append((999, "none", 5, "p", 5, None))
    got = {x.id: tuple(x)[1:] for x in R.fusion_peptides(spark.createDataFrame(rows, "id int, up_transcript string, up_position long, down_transcript string, down_position long, insert string"), t, e, c, 4).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 20

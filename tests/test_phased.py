"""Variants that change one codon together."""

from helixframe.functions.sequences import CODONS
from helixframe.operators import impact as E

SCHEMA = "id string, transcript string, lps int, shift int, codon int, ref_codon string, alt_codon string"


def of(spark, rows):
    return {r.id: r.phased for r in E.phased(spark.createDataFrame([(i, "t", *r) for i, r in rows.items()], SCHEMA)).collect()}


def test_stops_and_starts_of_combined_codons(spark):
    assert (CODONS["CTA"], CODONS["TTA"], CODONS["CAA"], CODONS["TAA"]) == ("L", "L", "Q", "*")
    got = of(spark, {
        "a1": (1, 0, 7, "CTA", "TTA"), "a2": (1, 0, 7, "CTA", "CAA"),  # together a stop
        "b1": (1, 0, 9, "TAA", "CAA"), "b2": (1, 0, 9, "TAA", "TAC"),  # a stop lost
        "c1": (1, 0, 0, "ATG", "ACG"), "c2": (1, 0, 0, "ATG", "ATA"),  # the start
        "d1": (1, 0, 12, "TTA", "CTA"), "d2": (1, 0, 12, "TTA", "TTG"),  # CTG, leucine still
        "e1": (1, 0, 15, "GAA", "GCA"), "e2": (1, 0, 15, "GAA", "GAT"),
        "f1": (1, 0, 20, "GAA", "GCA"), "f2": (1, 0, 20, "GAA", "GTA"),  # two bases at one place
        "g1": (1, 0, 22, "GAA", "GCA"), "g2": (None, 0, 22, "GAA", "GAT"), "g3": (2, 0, 22, "GAA", "GAT"),
        "h1": (1, 0, 30, "GAA", "GCA"), "h2": (1, 0, 30, "GAA", "GCA"),  # the same one twice
        "i1": (3, 1, None, None, None), "i2": (3, 2, None, None, None), "j1": (4, 1, None, None, None), "j2": (4, -1, None, None, None),
    })
    assert got == {
        "a1": "phased_missense;stop_gained", "a2": "phased_missense;stop_gained", "b1": "stop_lost", "b2": "stop_lost", "c1": "start_lost", "c2": "start_lost", "d1": "phased_synonymous", "d2": "phased_synonymous",
        "e1": "phased_missense", "e2": "phased_missense", "f1": None, "f2": None, "g1": None, "g2": None, "g3": None, "h1": None, "h2": None, "i1": "phased_inframe_insertion", "i2": "phased_inframe_insertion", "j1": "phased_missense", "j2": "phased_missense",
    }


def test_effects_over_exon_ends_and_of_several_bases(spark):
    from pyspark.sql import functions as F

    # Coding 101-130 and 141-170 of exons 101-130 and 141-170; bases by position.
    bases = "ATGCTAGAATACTGGCAAAAACGTTCAGGT" + "CTGTACGATGAACATATTAAAGTTTGGTAA"
    t = [("p", "g", "c", 1, 91, 180, 101, 170), ("m", "g", "d", -1, 91, 180, 101, 170)]
    e = [(n, a, b) for n in "pm" for a, b in ((91, 130), (141, 180))]
    v = {
        "over the end": ("c", 129, "GTNN", ""), "over the end, backwards": ("d", 129, "NNNN", ""), "over the begin": ("c", 139, "NNCT", ""), "before the end": ("c", 127, "GG", ""), "stop by an insertion": ("c", 109, "", "TAA"), "stop by two bases": ("c", 104, "CT", "TA"),
        "no stop": ("c", 109, "", "GCA"), "start gone": ("c", 102, "TG", "CC"), "three bases": ("c", 107, "GAA", ""), "stop gone": ("c", 168, "TAA", "CAC"), "same residue": ("c", 104, "CTA", "TTG"), "one base": ("c", 105, "T", "A"), "whole intron": ("c", 131, "N" * 10, ""),
    }
    variants = spark.createDataFrame([(k, *x, None) for k, x in v.items()], "id string, chromosome string, position long, ref string, alt string, lps int")
    got = E.effects(variants, spark.createDataFrame(t, "transcript string, gene string, chromosome string, strand int, trans_start long, trans_end long, coding_start long, coding_end long"), spark.createDataFrame(e, "transcript string, exon_start long, exon_end long"), spark.createDataFrame([("p", bases), ("m", bases)], "transcript string, bases string"))
    got = {r.id: r.e for r in got.select("id", F.array_join("effects", ";").alias("e")).collect()}
    assert got == {
        "over the end": "splice_donor;frameshift", "over the end, backwards": "splice_acceptor;frameshift", "over the begin": "splice_acceptor;frameshift", "before the end": "frameshift", "stop by an insertion": "inframe_insertion;stop_gained", "stop by two bases": "stop_gained",
        "no stop": "inframe_insertion", "start gone": "start_lost", "three bases": "inframe_deletion", "stop gone": "stop_lost", "same residue": "synonymous", "one base": "missense", "whole intron": "splice_donor;splice_acceptor;intronic",
    }

"""Sequence functions as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code in the order of codons over TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), CODE))


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGTacgt", "TGCAtgca")


def gc_content(s: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    n = F.length(s)
    return F.when(n > 0, (n - F.length(F.translate(s, "GC", ""))) / n)


def translated(s: Column) -> Column:
    """Amino acids of whole codons from the first base on; X for a codon with other letters."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    # One pass; a substring for each codon would count its way from the start.
    codons = F.regexp_extract_all(s, F.lit("(?s).{3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def hamming_within(a: Column, b: Column, most: int) -> Column:
    """Whether equal-length sequences differ in at most ``most`` places; other lengths never do."""
    gaps = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (F.length(a) == F.length(b)) & (gaps <= most)


def kmers(s: Column, k: int) -> Column:
    """All substrings of length k, in order: what lies ahead of each place, in one pass."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def cigar_length(cigar: Column, operations: str) -> Column:
    """Sum of the lengths of the given operations; ``MIS=X`` is the read's length, ``MDN=X`` the reference's."""
    parts = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{operations}]"), F.lit(1))
    return F.aggregate(F.transform(parts, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def soft_clip(cigar: Column, left: bool) -> Column:
    """Length of the soft clip at one end, 0 without."""
    found = F.regexp_extract(cigar, "^(?:[0-9]+H)?([0-9]+)S" if left else "([0-9]+)S(?:[0-9]+H)?$", 1)
    return F.when(found == "", 0).otherwise(found.try_cast("int"))


def reference_position(cigar: Column, start: Column, index: Column) -> Column:
    """Reference position of the read's base at ``index`` (from 0), or null inside an insertion or clip."""
    parts = F.zip_with(F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(2)), lambda n, o: F.struct(n.cast("long").alias("n"), o.alias("o")))
    zero = F.struct(F.lit(0).cast("long").alias("r"), start.cast("long").alias("p"), F.lit(None).cast("long").alias("found"))

    def step(s: Column, x: Column) -> Column:
        both, read, ref = x["o"].isin("M", "=", "X"), x["o"].isin("I", "S"), x["o"].isin("D", "N")
        hit = both & (index >= s["r"]) & (index < s["r"] + x["n"])
        return F.struct((s["r"] + F.when(both | read, x["n"]).otherwise(0)).alias("r"), (s["p"] + F.when(both | ref, x["n"]).otherwise(0)).alias("p"), F.coalesce(s["found"], F.when(hit, s["p"] + index - s["r"])).alias("found"))

    return F.aggregate(parts, zero, step, lambda s: s["found"])


def trinucleotide(ref: Column, alt: Column, context: Column) -> Column:
    """Bucket such as ``C>A_ACA``, turned so that the changed base is a pyrimidine."""
    turn = ref.isin("A", "G")
    r, a, c = (F.when(turn, reverse_complement(x)).otherwise(x) for x in (ref, alt, context))
    return F.concat(r, F.lit(">"), a, F.lit("_"), c)


#: All 96 buckets in order: ref, alt, base before, base after.
TRINUCLEOTIDES = [f"{r}>{a}_{b}{r}{c}" for r in "CT" for a in "ACGT" if a != r for b in "ACGT" for c in "ACGT"]


def telomere_repeats(s: Column) -> Column:
    """The larger count of TTAGGG and CCCTAA, without overlaps."""
    return F.greatest(F.regexp_count(s, F.lit("TTAGGG")), F.regexp_count(s, F.lit("CCCTAA")))


def longest_repeat(s: Column, unit: int) -> Column:
    """The longest run of one unit of the given length (twice or more), leftmost of equals, or an empty text."""
    runs = F.regexp_extract_all(s, F.lit(f"(([ACGT]{{{unit}}})\\2+)"), F.lit(1))
    return F.aggregate(runs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def homology(left: Column, right: Column, most: int) -> Column:
    """Number of first bases, ``most`` at most, in which both sequences agree."""
    same = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: (F.length(left) >= i) & (F.length(right) >= i) & (F.substring(left, F.lit(1), i) == F.substring(right, F.lit(1), i)))
    return F.size(F.filter(same, lambda x: x))


def hashed_id(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(value.cast("string"), F.lit(salt)), 256)


def hgvs_coding(position: Column, ref: Column, alt: Column) -> Column:
    """``c.`` description of a substitution, deletion, insertion or delins at a coding position (ref and alt without a common anchor)."""
    end = position + F.length(ref) - 1
    span = F.when(F.length(ref) <= 1, position.cast("string")).otherwise(F.concat(position.cast("string"), F.lit("_"), end.cast("string")))
    change = (
        F.when((F.length(ref) == 1) & (F.length(alt) == 1), F.concat(position.cast("string"), ref, F.lit(">"), alt))
        .when(F.length(alt) == 0, F.concat(span, F.lit("del")))
        .when(F.length(ref) == 0, F.concat(position.cast("string"), F.lit("_"), (position + 1).cast("string"), F.lit("ins"), alt))
        .otherwise(F.concat(span, F.lit("delins"), alt))
    )
    return F.concat(F.lit("c."), change)


def hgvs_parts(text: Column) -> Column:
    """struct(start, end, ref, kind, alt) of a ``c.`` description; null where it is none."""
    pattern = r"^c\.([0-9]+)(?:_([0-9]+))?([ACGT]*)(>|delins|del|ins|dup)([ACGT]*)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    start = part(1).try_cast("int")
    return F.when(part(4) != "", F.struct(start.alias("start"), F.coalesce(part(2).try_cast("int"), start).alias("end"), part(3).alias("ref"), part(4).alias("kind"), part(5).alias("alt")))

"""From proteins back to variants, and proteins across fused genes: both read a transcript's coding bases by the places of its coding exons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import CODONS, reverse_complement, translated

#: Residues by their names of three letters.
RESIDUES = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Ter": "*"}


def coding_exons(transcripts: DataFrame, exons: DataFrame) -> DataFrame:
    """(transcript, chromosome, strand, g_start, g_end, c_from, c_to): the coding part of each exon, and its coding bases, counted from 0 in the transcript's direction.

    transcripts and exons: as ``impact.effects`` takes them. A transcript's exons are few, so a window by transcript is small.
    """
    both = transcripts.filter("coding_start IS NOT NULL").select("transcript", "chromosome", "strand", "coding_start", "coding_end").join(exons.select("transcript", "exon_start", "exon_end"), "transcript")
    part = both.select("transcript", "chromosome", "strand", F.greatest("exon_start", "coding_start").alias("g_start"), F.least("exon_end", "coding_end").alias("g_end")).filter("g_start <= g_end")
    order = Window.partitionBy("transcript").orderBy(F.col("g_start") * F.col("strand"))
    size = F.col("g_end") - F.col("g_start") + 1
    upto = F.sum(size).over(order)
    return part.withColumn("c_from", upto - size).withColumn("c_to", upto - 1)


def _short(text: Column) -> Column:
    for name, letter in RESIDUES.items():
        text = F.replace(text, F.lit(name), F.lit(letter))
    return text


def _parts(short: Column) -> Column:
    """The raw parts of a change, each empty where it has none."""
    pattern = "^p\\.([A-Z*])([0-9]+)(?:([A-Z*=])|(?:_[A-Z*]([0-9]+))?(del|dup))$"
    return F.struct(*[F.regexp_extract(short, pattern, i).alias(n) for i, n in enumerate(("ref", "first", "alt", "last", "block"), 1)])


def _named(parts: Column) -> Column:
    number = lambda n: F.when(parts[n] != "", parts[n].try_cast("int"))  # noqa: E731  # a cast of an empty text raises an error inside, which takes longer than all the rest
    is_sub, is_block = parts["alt"] != "", parts["block"] != ""
    return F.struct(
        F.when(is_sub, "sub").when(is_block, parts["block"]).alias("kind"), number("first").alias("first"), F.coalesce(number("last"), number("first")).alias("last"),
        parts["ref"].alias("ref"), F.when(is_sub, F.when(parts["alt"] == "=", parts["ref"]).otherwise(parts["alt"])).alias("alt"),
    )


def parsed(text: Column) -> Column:
    """A struct (kind, first, last, ref, alt) of a protein change like ``p.V600E``, ``p.Val600Glu``, ``p.K4=``, ``p.K4_L6del`` or ``p.K4dup``; kind is sub, del or dup, and null for others. ref is the first residue."""
    return _named(_parts(_short(text)))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that is evaluated once for each: filters on it aren't moved through a generator, which would write it into every place that reads it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _residue(codon: Column) -> Column:
    """The residue of one codon; X for other letters, and null where bases are missing."""
    return F.when(F.length(codon) == 3, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv]), codon), F.lit("X")))


def _substitutions(rows: DataFrame) -> DataFrame:
    """Of a codon, the bases to change for each other codon of the wanted residue: from the first to the last that differs."""
    of = {a: F.array(*[F.lit(c) for c, x in sorted(CODONS.items()) if x == a]) for a in sorted(set(CODONS.values()))}
    codons = F.try_element_at(F.create_map(*[x for a, own in of.items() for x in (F.lit(a), own)]), F.col("alt"))
    each = _once(rows.filter("kind = 'sub'"), "own", F.substring("bases", (F.col("first") - 1) * 3 + 1, F.lit(3)))
    each = each.filter((F.length("own") == 3) & (_residue(F.col("own")) == F.col("ref"))).withColumn("to", F.explode(codons)).filter("to != own")
    same = [F.substring("to", i, 1) == F.substring("own", i, 1) for i in (1, 2, 3)]
    lo = F.when(~same[0], 0).when(~same[1], 1).otherwise(2)
    hi = F.when(~same[2], 2).when(~same[1], 1).otherwise(0)
    each = each.withColumn("lo", lo).withColumn("hi", hi)
    cut = lambda c: F.substring(c, F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)
    return each.select("id", "transcript", ((F.col("first") - 1) * 3 + F.col("lo")).alias("c"), cut(F.col("own")).alias("old"), cut(F.col("to")).alias("new"))


def _deletions(rows: DataFrame) -> DataFrame:
    """Bases of whole codons' number whose loss takes out the residues: begun at the first one's codon, or up to two bases beside it where the residues around stay what they are."""
    lead = F.when(F.col("first") > 1, 3).otherwise(0)
    each = rows.filter("kind = 'del'").withColumn("size", 3 * (F.col("last") - F.col("first") + 1)).withColumn("lead", lead)
    each = _once(each, "near", F.substring("bases", (F.col("first") - 1) * 3 + 1 - F.col("lead"), F.col("lead") + F.col("size") + 3))
    without = lambda at: F.concat(F.substring("near", F.lit(1), at), F.substring("near", at + F.col("size") + 1, F.length("near")))
    each = each.filter(_residue(F.substring("near", F.col("lead") + 1, F.lit(3))) == F.col("ref"))
    each = _once(each, "wanted", translated(without(F.col("lead")))).withColumn("d", F.explode(F.array(*[F.lit(d) for d in (-2, -1, 0, 1, 2)])))
    each = each.withColumn("at", F.col("lead") + F.col("d")).filter("at >= 0 AND length(near) >= at + size").filter(translated(without(F.col("at"))) == F.col("wanted"))
    c = (F.col("first") - 1) * 3 + F.col("d")
    return each.select("id", "transcript", c.alias("c"), F.substring("near", F.col("at") + 1, F.col("size")).alias("old"), F.lit("").alias("new"))


def _duplications(rows: DataFrame) -> DataFrame:
    """The bases of the residues once more, behind them."""
    size = 3 * (F.col("last") - F.col("first") + 1)
    more = F.substring("bases", (F.col("first") - 1) * 3 + 1, size)
    each = _once(rows.filter("kind = 'dup'"), "more", more).filter((F.length("more") == size) & (_residue(F.substring("more", 1, 3)) == F.col("ref")))
    return each.select("id", "transcript", (3 * F.col("last")).alias("c"), F.lit("").alias("old"), F.col("more").alias("new"))


def variants_behind(changes: DataFrame, transcripts: DataFrame, exons: DataFrame, coding: DataFrame) -> DataFrame:
    """(id, transcript, chromosome, position, ref, alt): all variants on the genome, none with bases to spare, that make the protein changes (id, transcript, protein).

    ref and alt are as ``impact.effects`` takes them: without common bases, an insertion after ``position``. Changes of a residue give every block of bases that makes another codon of the new one; losses give every begin that leaves the
    same residues; duplications the one insertion behind. Blocks over the end of an exon have no variant of one piece and are left out, like changes whose residue isn't the transcript's, of other kinds, and of transcripts without
    coding bases. Equal rows give equal rows.
    """
    read = _once(_once(changes.select("id", "transcript", "protein"), "short", _short(F.col("protein"))), "parts", _parts(F.col("short")))
    rows = read.select("id", "transcript", _named(F.col("parts")).alias("p")).select("id", "transcript", "p.*").filter("kind IS NOT NULL AND first > 0 AND last >= first").join(coding.select("transcript", "bases"), "transcript")
    found = _substitutions(rows).union(_deletions(rows)).union(_duplications(rows))
    c, size = F.col("c"), F.length("old")
    last = F.when(size > 0, c + size - 1).otherwise(c - 1)  # of an insertion, the base before it
    met = found.withColumn("begin", F.when(size > 0, c).otherwise(c - 1)).withColumn("end", last).join(coding_exons(transcripts, exons), "transcript").filter("begin >= c_from AND end <= c_to")
    plus = F.col("strand") > 0
    position = F.when(plus, F.col("g_start") + F.col("begin") - F.col("c_from")).otherwise(F.col("g_end") - (F.col("end") - F.col("c_from")) - F.when(F.length("old") > 0, 0).otherwise(1))
    turned = lambda x: F.when(plus, F.col(x)).otherwise(reverse_complement(F.col(x)))
    return met.select("id", "transcript", "chromosome", position.alias("position"), turned("old").alias("ref"), turned("new").alias("alt"))


def fusion_peptides(fusions: DataFrame, transcripts: DataFrame, exons: DataFrame, coding: DataFrame, flank: int = 10) -> DataFrame:
    """(id, in_frame, upstream, novel, downstream, stopped) of fusions (id, up_transcript, up_position, down_transcript, down_position, insert): residues across a junction.

    The first transcript is read up to its position, that one included, then insert (null: none) and the second from its position on; in an intron the exons before and behind it count. In frame, novel residues are those with bases of both or of the
    insert, and downstream has ``flank`` residues of the second protein; out of frame, all from the junction to the first stop are novel, and downstream is empty. upstream has ``flank`` residues before. stopped: a stop
    was read. A stop before the junction leaves nothing novel. Fusions of transcripts without coding bases are left out; nothing is in frame before the first coding base of the first or behind the last of the second.
    """
    parts = coding_exons(transcripts, exons)
    counted = lambda side, shift: (
        fusions.select("id", F.col(f"{side}_transcript").alias("transcript"), F.col(f"{side}_position").alias("p")).join(parts, "transcript")
        .groupBy("id").agg(F.sum(F.greatest(F.lit(0), F.when(F.col("strand") > 0, F.least("g_end", F.col("p") - shift) - F.col("g_start") + 1).otherwise(F.col("g_end") - F.greatest("g_start", F.col("p") + shift) + 1))).alias(f"{side}_offset"))
    )
    bases = lambda side: coding.select(F.col("transcript").alias(f"{side}_transcript"), F.col("bases").alias(f"{side}_bases"))
    rows = fusions.join(counted("up", 0), "id").join(counted("down", 1), "id").join(bases("up"), "up_transcript").join(bases("down"), "down_transcript")
    c = F.col
    insert = F.coalesce("insert", F.lit(""))
    head = F.substring("up_bases", F.lit(1), c("up_offset").cast("int"))
    tail = F.substring("down_bases", (c("down_offset") + 1).cast("int"), F.length("down_bases"))
    rows = rows.withColumns({"__head": head, "__tail": tail, "__insert": insert})
    rows = rows.withColumn("__n", F.length("__head") + F.length("__insert"))
    rows = rows.withColumn("__all", translated(F.concat("__head", "__insert", "__tail"))).withColumn("in_frame", (F.pmod(c("__n") - c("down_offset"), F.lit(3)) == 0) & (F.length("__head") > 0) & (F.length("__tail") > 0))
    stop = F.instr("__all", "*")
    rows = rows.withColumn("stopped", stop > 0).withColumn("__all", F.when(stop > 0, F.substring("__all", F.lit(1), stop - 1)).otherwise(c("__all")))
    begin = F.floor(F.length("__head") / 3).cast("int")
    end = F.when(c("in_frame"), F.ceil(c("__n") / 3).cast("int")).otherwise(F.length("__all"))
    rows = rows.withColumn("__a", begin).withColumn("__b", F.greatest(begin, end))
    upstream = F.substring("__all", F.greatest(F.lit(0), c("__a") - flank) + 1, F.least(F.lit(flank), c("__a")))
    novel = F.substring("__all", c("__a") + 1, c("__b") - c("__a"))
    downstream = F.when(c("in_frame"), F.substring("__all", c("__b") + 1, F.lit(flank))).otherwise("")
    return rows.select("id", "in_frame", upstream.alias("upstream"), novel.alias("novel"), downstream.alias("downstream"), "stopped")

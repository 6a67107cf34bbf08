"""HLA, pharmacogenes, receptors, neoepitopes and panels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import hamming_within
from ..shipping import ship
from ..storage import discarded, stored


def ranked_complexes(complexes: DataFrame, sample: str, score: str, coverage: str, name: str, spread: float = 0.01, cull: float = 0.25) -> DataFrame:
    """Complexes of each sample with a score of at least the top less ``spread`` of the top's coverage, two at least, ranked; first those that lack too much coverage are culled."""
    top = Window.partitionBy(sample)
    order = top.orderBy(F.desc(score), name)
    rows = complexes.withColumn("__most", F.max(coverage).over(top)).filter(F.col(coverage) >= F.col("__most") * (1 - cull))
    rows = rows.withColumns({"rank": F.row_number().over(order), "__best": F.max(score).over(top), "__cover": F.first(coverage).over(order)})
    return rows.filter((F.col(score) >= F.col("__best") - spread * F.col("__cover")) | (F.col("rank") <= 2)).drop("__most", "__best", "__cover")


def complex_scores(fragments: DataFrame, frequencies: dict[str, float], genes: int = 3, weight: float = 0.018, floor: float = 0.0001, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """(by, first, second, coverage, score): all allele pairs of each gene by the fragments (by, alleles) that they explain; by holds the gene, and the sample where there are several.

    A homozygous pair counts its allele's frequency twice. Fragments are first counted by their allele set, so pairs of a gene's few candidate alleles meet distinct sets.
    """
    keys = list(by)
    sets = fragments.select(*keys, F.array_sort(F.array_distinct("alleles")).alias("alleles")).groupBy(*keys, "alleles").agg(F.count("*").alias("n"))
    names = sets.select(*keys, F.explode("alleles").alias("first")).distinct()
    pairs = names.join(names.withColumnRenamed("first", "second"), keys).filter("first <= second")
    holds = F.array_contains("alleles", F.col("first")) | F.array_contains("alleles", F.col("second"))
    covered = pairs.join(sets, keys).groupBy(*keys, "first", "second").agg(F.sum(F.when(holds, F.col("n")).otherwise(0)).alias("coverage"))
    table = F.create_map(*[F.lit(x) for k, v in (frequencies or {"": floor}).items() for x in (k, float(v))])
    common = lambda c: F.log10(F.greatest(F.coalesce(F.try_element_at(table, F.col(c)), F.lit(0.0)), F.lit(floor)))
    return covered.withColumn("score", F.col("coverage") + 3 / genes * (common("first") + common("second")) * weight * F.col("coverage"))


def haplotypes(observed: dict[str, int | None], known: dict[str, dict[str, int]], default: str, copies: int = 2) -> dict[str, int]:
    """The combination of haplotypes that explains all observed variant counts, padded with the default to ``copies``; empty without one, or with an unknown count.

    Known haplotypes are maps of events to counts. Of several combinations the one whose size is nearest to ``copies`` wins, then the one with fewest defaults, then by name.
    """
    if any(v is None for v in observed.values()):
        return {}
    names = sorted(k for k, v in known.items() if v)
    found: list[tuple[str, ...]] = []

    def walk(left: dict[str, int], first: int, taken: tuple[str, ...]) -> None:
        if not any(left.values()):
            found.append(taken)
            return
        for i in range(first, len(names)):
            need = known[names[i]]
            if all(left.get(e, 0) >= n for e, n in need.items()):
                walk({e: n - need.get(e, 0) for e, n in left.items()}, i, (*taken, names[i]))

    walk({k: int(v) for k, v in observed.items()}, 0, ())
    if not found:
        return {}
    best = min(found, key=lambda t: (abs(len(t) - copies), max(0, copies - len(t)), t))
    out: dict[str, int] = {}
    for n in best + (default,) * max(0, copies - len(best)):
        out[n] = out.get(n, 0) + 1
    return out


def called_haplotypes(events: DataFrame, known: dict[str, dict[str, dict[str, int]]], default: dict[str, str]) -> DataFrame:
    """(sample, gene, haplotype, count) from events (sample, gene, event, count) for each gene of a panel; a gene without a call has one row, Unresolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, names, counts = [], [], []
            for i, (gene, own) in enumerate(zip(batch["gene"].to_pylist(), batch["__own"].to_pylist())):
                seen = {x["event"]: (None if x["count"] is None or x["count"] != x["count"] else int(x["count"])) for x in own}
                got = haplotypes(seen, known.get(gene, {}), default.get(gene, "*1")) or {"Unresolved": 0}
                row += [i] * len(got)
                names += got.keys()
                counts += got.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["sample"].take(at), batch["gene"].take(at), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["sample", "gene", "haplotype", "count"])

    kind = events.schema["sample"].dataType.simpleString()
    ship(events.sparkSession)
    # A row for each gene of a sample, many to a batch: a panel's events are few.
    return events.groupBy("sample", "gene").agg(F.collect_list(F.struct("event", "count")).alias("__own")).mapInArrow(run, f"sample {kind}, gene string, haplotype string, count long")


#: Sizes of a bitmap of sequences, as powers of two; beyond the last, pieces that are there by chance alone cost rows and no result.
FEWEST_BITS, MOST_BITS = 16, 28
#: The reads from which a sequence is of class 1, 2 and 3; one is held by sequences of its own class or a higher one only.
CLASSES = [2, 4, 16]
_BASE, _MIX, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for factor in (np.uint64(1), _SECOND):
        yield (keys * factor) >> np.uint64(64 - bits)


class _Texts:
    """The UTF-8 bytes of a batch's sequences (s, own: a hash of the locus, n), with hashes of all their pieces at hand."""

    def __init__(self, batch: pa.RecordBatch):
        text = batch["s"].to_pylist()
        rows = [x.encode() for x in text]
        self.data = np.frombuffer(b"".join(rows), np.uint8)
        self.size = np.array([len(x) for x in rows], np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.size)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        power = np.cumprod(np.full(len(self.data) + 1, _BASE, np.uint64))
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        self.back = np.cumprod(np.full(len(self.data) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64))
        # Where a character begins, or the texts end.
        self.lead = np.append((self.data & 0xC0) != 0x80, True)
        self.own = batch["own"].to_numpy().view(np.uint64)
        self.rank = np.searchsorted(CLASSES, batch["n"].to_numpy(), "right")

    def hashes(self, at: np.ndarray, size, row: np.ndarray) -> np.ndarray:
        return _mixed((self.total[at + size] - self.total[at]) * self.back[at] ^ self.own[row])


def _of_class(hashes: np.ndarray, rank) -> np.ndarray:
    return _mixed(hashes + np.asarray(rank, np.uint64) * _SECOND)


def sequence_bitmap(sequences: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, two of which are set for each of the sequences (s, own, n) and its class; the driver gets a row for each 64 bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Texts(batch)
            keys = _of_class(found.hashes(found.start, found.size, np.arange(len(found.size))), found.rank)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*_slots(keys, bits)]).view(np.int64))], ["slot"])

    slots = sequences.select("s", "own", "n").mapInArrow(run, "slot long")
    lanes = slots.groupBy(F.shiftright("slot", 6).alias("lane")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[lanes["lane"].to_numpy()] = lanes["bits"].to_numpy()
    return out.view(np.uint8)


def held_pieces(sequences: DataFrame, bits: int) -> DataFrame:
    """(l, s, to): the proper pieces s of each sequence (l, s, id, own, n) that may be sequences of no more reads, with its id; where a piece of another locus or none has the same hashes, there are more."""
    known = sequences.sparkSession.sparkContext.broadcast(sequence_bitmap(sequences, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value

        def there(keys: np.ndarray) -> np.ndarray:
            at = np.arange(len(keys))
            for slot in _slots(keys, bits):
                here = slot[at]
                at = at[(table[here >> np.uint64(3)] >> (here & np.uint64(7)).astype(np.uint8)) & 1 > 0]
            return at

        for batch in batches:
            found = _Texts(batch)
            at, left = np.arange(len(found.data)), found.end[found.row]
            at = at[found.lead[:-1]]
            for size in range(1, int(found.size.max(initial=0))):
                at = at[at + size <= left[at]]
                some = at[found.lead[at + size]]
                row = found.row[some]
                proper = found.size[row] > size
                some, row = some[proper], row[proper]
                hashes, rank = found.hashes(some, size, row), found.rank[row]
                kept = []
                for c in range(len(CLASSES) + 1):
                    able = np.flatnonzero(rank >= c)
                    kept.append(able[there(_of_class(hashes[able], c))])
                kept = np.unique(np.concatenate(kept))
                if len(kept):
                    text = pa.Array.from_buffers(pa.string(), len(kept), [None, pa.py_buffer((np.arange(len(kept) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(found.data[some[kept][:, None] + np.arange(size)]))])
                    rows = pa.array(row[kept])
                    yield pa.RecordBatch.from_arrays([batch["l"].take(rows), text, batch["id"].take(rows)], ["l", "s", "to"])

    return sequences.mapInArrow(run, f"l {sequences.schema['l'].dataType.simpleString()}, s string, to long")


def collapsed_sequences(reads: DataFrame, locus: str, sequence: str, rounds: int = 1000) -> DataFrame:
    """(locus, sequence, support): each sequence, in the order of more reads, greater length and text, adds to the first kept one that holds it or equals it but for one substitution; without any it is kept.

    Sequences are numbered in that order. They meet by those of their pieces that a bitmap of all sequences knows, and by hashes of what is left of them without one letter; both are then compared as texts. Which are kept is settled by
    rounds of joins over those pairs of numbers: a sequence without an earlier undecided or kept partner is kept, and the partners after it are not.
    """
    spark, text = reads.sparkSession, F.col("s")
    ship(spark)
    counted = stored(reads.groupBy(F.struct(F.col(locus).alias("own")).alias("l"), F.col(sequence).alias("s")).agg(F.count("*").alias("n")).filter("s IS NOT NULL"), "sequences")
    order = [F.desc("n"), F.desc(F.length("s")), F.asc("s"), F.asc("l")]
    dealt = counted.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    every = stored(dealt.select(F.monotonically_increasing_id().alias("id"), "l", "s", "n"), "ranked")
    discarded(counted)
    bits = min(MOST_BITS, max(FEWEST_BITS, (16 * every.count()).bit_length()))
    holds = held_pieces(every.withColumn("own", F.xxhash64("l")), bits).join(every.select("l", "s", "id"), ["l", "s"]).filter("to < id").select("id", "to")
    # Every sequence holds the empty one, and the first of a locus is always kept.
    empty = every.filter("s = ''").select("l", "id").join(every.groupBy("l").agg(F.min("id").alias("to")), "l").filter("to < id").select("id", "to")
    gaps = every.select("id", F.explode(F.transform(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64("l", i, F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))).alias("h"))
    near = gaps.join(gaps.withColumnRenamed("id", "to"), "h").filter("to < id").select("id", "to").distinct()
    own, other = every.select("id", "l", "s"), every.select(F.col("id").alias("to"), F.col("l").alias("m"), F.col("s").alias("t"))
    alike = near.join(own, "id").join(other, "to").filter((F.col("l") == F.col("m")) & hamming_within(F.col("s"), F.col("t"), 1)).select("id", "to")
    pairs = stored(holds.union(empty).union(alike).distinct(), "pairs")
    kept, edges, open_ = None, pairs, every.select("id")
    for _ in range(rounds):
        first = stored(open_.join(edges, "id", "left_anti"), "kept")
        kept = first if kept is None else kept.union(first)
        if edges.isEmpty():
            break
        gone = stored(edges.join(first.withColumnRenamed("id", "to"), "to", "left_semi").select("id").distinct(), "gone")
        before = open_, edges
        open_ = stored(open_.join(first, "id", "left_anti").join(gone, "id", "left_anti"), "open")
        edges = stored(edges.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "to"), "to", "left_anti").select("id", "to"), "edges")
        discarded(gone)
        discarded(before[0])
        if before[1] is not pairs:
            discarded(before[1])
    else:
        raise RuntimeError(f"sequences did not settle in {rounds} rounds")
    joined = pairs.join(kept.withColumnRenamed("id", "to"), "to").join(kept, "id", "left_anti").groupBy("id").agg(F.min("to").alias("to"))
    support = kept.select("id", F.col("id").alias("to")).unionByName(joined).join(every.select("id", "n"), "id").groupBy("to").agg(F.sum("n").alias("support"))
    return every.join(support, F.col("id") == F.col("to")).select(F.col("l.own").alias(locus), F.col("s").alias(sequence), "support")


def peptides(proteins: DataFrame, ident: str, protein: str, lengths: list[int]) -> DataFrame:
    """(ident, position, peptide) of each length: a sliding window over every protein."""
    from ..functions.sequences import kmers

    each = F.flatten(F.array(*[F.transform(kmers(F.col(protein), k), lambda p, i: F.struct((i + 1).alias("position"), p.alias("peptide"))) for k in lengths]))
    return proteins.select(ident, F.explode(each).alias("p")).select(ident, "p.position", "p.peptide")


def position_weights(peptide_counts: DataFrame, allele: str, peptide: str, count: str) -> DataFrame:
    """(allele, length, position, residue, weight): log2 of the smoothed share over a uniform residue."""
    each = peptide_counts.select(allele, F.length(peptide).alias("length"), F.posexplode(F.filter(F.split(peptide, ""), lambda x: x != "")).alias("position", "residue"), count)
    sums = each.groupBy(allele, "length", "position", "residue").agg(F.sum(count).alias("n"))
    total = F.sum("n").over(Window.partitionBy(allele, "length", "position"))
    return sums.select(allele, "length", "position", "residue", F.log2((F.col("n") + 1) / (total + 20) * 20).alias("weight"))


def probes(regions: DataFrame, ident: str, start: str, end: str, size: int, step: int) -> DataFrame:
    """(ident, probe_start, probe_end): tiles of ``size`` bases over a region, the last one moved back to its end; a shorter region has one centred tile."""
    length = F.col(end) - F.col(start) + 1
    centred = F.array(F.floor((F.col(start) + F.col(end) + 1 - size) / 2).cast("long"))
    tiled = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((length - size) / step)).cast("long")), lambda i: F.least(F.col(start) + i * step, F.col(end) - size + 1)))
    return regions.select(ident, F.explode(F.when(length <= size, centred).otherwise(tiled)).alias("probe_start")).withColumn("probe_end", F.col("probe_start") + size - 1)

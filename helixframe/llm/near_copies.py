"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, links followed transitively.

Candidates come from the multi-index hashing of ``simhash``: sets whose fingerprints it links, directly or over others, are a band. Two texts of similarity 0.8 differ in about ten of 64 bits, and
balls of that radius hold too many keys to enumerate; for what lies beyond two bits there are 20 bands more, of 4 least hashes each, of which a pair at 0.8 shares one but for 3 in 100,000 cases.
Every candidate's similarity is verified on the whole sets.

Texts of the same set are one node. A band of up to ``HOT`` nodes gives all its pairs. In a larger one (near copies of one text), where pairs
would grow with the square, each member meets two hubs first, of which one is the band's most central member. What these verified links leave in several components is then searched
exactly: members outside a crowded band's largest component meet those of other components by a prefix filter over their rarest shingles, which no pair of the similarity
escapes. So no pair that shares a band is lost, and rows stay near those of the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import in_batches, stored, utf8

WORDS = 5
SHARE = (4, 5)
BANDS, ROWS = 20, 4
HOT = 32
_R = np.random.default_rng(20)
XORS = _R.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
FACTORS = _R.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles are counted by so many bits of their hashes, up to 127; collisions cost rows and no links.
SLOT_BITS = 24


def shingle_sets(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; none without words."""
    out = [np.zeros(0, np.uint64)] * (len(at) - 1)
    for lo, hi, hashes, edge in simhash.shingle_hashes(data, at, WORDS):
        for i in range(hi - lo):
            out[lo + i] = np.unique(hashes[edge[i] : edge[i + 1]])
    return out


def key(own: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed long; zero for the empty set alone."""
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes()) or 1], np.uint64).view(np.int64)[0]) if len(own) else 0


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each of the sets, which are not empty."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    if not sets:
        return out.view(np.int64)
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for b in range(BANDS):
        mixed = np.full(len(sets), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            mixed = (mixed ^ np.minimum.reduceat((every ^ XORS[i]) * FACTORS[i], starts)) * MIX
            mixed ^= mixed >> np.uint64(29)
        out[:, b] = mixed
    return out.view(np.int64)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprint of each of the sets, which are not empty: a bit is set if more than half of the hashes set it."""
    out = np.zeros(len(sets), np.int64)
    for i, own in enumerate(sets):
        ones = np.zeros(64, np.int64)
        for z in range(0, len(own), 1 << 18):  # a long text in pieces
            ones += np.unpackbits(own[z : z + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(own), bitorder="little").view(np.int64)[0]
    return out


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp, n, sim, bands): fp stands for the set of shingles, n is its size, sim its SimHash fingerprint, zero without words; bands is empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*utf8(batch.column(1)))
            sizes = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(sizes)
            found = np.concatenate([bands([sets[i] for i in some[c : c + 64]]) for c in range(0, len(some), 64)]) if len(some) else np.zeros((0, BANDS), np.int64)
            sims = np.zeros(len(sets), np.int64)
            sims[some] = fingerprints([sets[i] for i in some])
            offsets = np.concatenate([[0], np.cumsum(sizes > 0) * BANDS]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([key(s) for s in sets], pa.int64()), pa.array(sizes), pa.array(sims), lists], ["id", "fp", "n", "sim", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long, n long, sim long, bands array<long>")


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, own): own is the set's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "fp", "own"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long, own binary")


def _alike(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can have the similarity."""
    return F.least(n, m) * SHARE[1] >= F.greatest(n, m) * SHARE[0]


def hashed(distinct: DataFrame) -> DataFrame:
    """(fp, n, band) of sets (fp, n, sim): a band holds the sets that multi-index hashing of their fingerprints ties together, at two bits or fewer from one to the next."""
    roots = simhash.components(simhash.links(distinct.select(F.col("sim").alias("fp")).distinct()))
    return distinct.join(roots, F.col("sim") == F.col("node"), "left").select("fp", "n", F.xxhash64(F.lit("simhash"), F.coalesce("root", "sim")).alias("band"))


def candidates(members: DataFrame, sizes: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b, distinct: members (band, fp, n) of bands up to ``hot`` that share one; and the members of larger bands."""
    few = members.join(sizes.filter(F.col("m") <= hot).select("band"), "band", "left_semi")
    pairs = few.join(few.select("band", F.col("fp").alias("b"), F.col("n").alias("m")), "band").filter(F.col("fp") < F.col("b")).filter(_alike(F.col("n"), F.col("m")))
    return pairs.select(F.col("fp").alias("a"), "b").distinct(), stored(members.join(sizes.filter(F.col("m") > hot), "band"), "crowds")


def hub_pairs(crowds: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: each member of a crowd (band, fp, n, m) with its band's two hubs.

    One is the member with the largest bands in sum, which is the original where others are copies of it; the other is chosen by a hash of the band, so other bands have other ones.
    """
    central = crowds.groupBy("fp").agg(F.sum("m").alias("c"))
    one = F.max_by(F.struct("fp", "n"), F.struct("c", F.xxhash64("fp", "band"))).alias("g")
    hubs = crowds.join(central, "fp").groupBy("band").agg(one, F.min_by(F.struct("fp", "n"), F.xxhash64("fp", "band")).alias("h"))
    each = hubs.select("band", F.explode(F.array("g", "h")).alias("h"))
    pairs = crowds.join(each, "band").filter((F.col("fp") != F.col("h.fp")) & _alike(F.col("n"), F.col("h.n")))
    return pairs.select(F.least("fp", "h.fp").alias("a"), F.greatest("fp", "h.fp").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (fp, own) have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both * SHARE[1] >= (len(x) + len(y) - both) * SHARE[0]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    one = pairs.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a")
    two = one.join(sets.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")
    return in_batches(two).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def left_apart(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, n, root, out): the members of crowded bands (band, fp, n) that hold several components; out: outside the largest one of some band. roots: (node, root), of nodes with links."""
    named = crowds.select("band", "fp", "n").join(roots, F.col("fp") == F.col("node"), "left").select("band", "fp", "n", F.coalesce("root", "fp").alias("root"))
    sizes = named.groupBy("band", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("band").agg(F.count("*").alias("k"), F.max_by("root", F.struct("c", "root")).alias("top")).filter("k > 1").select("band", "top")
    return named.join(mixed, "band").groupBy("fp").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.max(F.col("root") != F.col("top")).alias("out"))


def _slots(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def rarest_first(members: DataFrame) -> DataFrame:
    """(shingle, fp, n, root, out, left): of each member (.., own) as many of its rarest shingles as a set of the similarity must share one of; left: how many of its shingles from this one on others may have.

    Of sets x and y that share t of their union, each holds a shared one among its first size - ceil(t size) + 1, in any order that is the same for all. Members of whose shingles too few stand anywhere else have none: they are
    similar to nothing here.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, n = np.unique(np.concatenate([_slots(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column(0)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n)], ["slot", "n"])

    many = F.least(F.sum("n"), F.lit(127)).cast("byte")
    found = in_batches(members).select("own").mapInArrow(count, "slot long, n long").groupBy("slot").agg(many.alias("n")).select(F.col("slot").cast("int"), "n").toArrow()  # five bytes for each slot at most
    often = np.zeros(1 << SLOT_BITS, np.int8)
    often[found["slot"].to_numpy()] = found["n"].to_numpy()
    held = members.sparkSession.sparkContext.broadcast(often)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = held.value
        for batch in batches:
            out, sizes, left = [], [], []
            for x in batch.column(4):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                seen = often[_slots(own)]
                known = int((seen > 1).sum())
                least = -(-len(own) * SHARE[0] // SHARE[1])
                # Shingles that stand once lead nowhere, so of the first ones only the others are joined.
                by = np.lexsort((own, seen))[: len(own) - least + 1] if known >= least else np.zeros(0, np.int64)
                by = by[seen[by] > 1]
                out.append(own[by].view(np.int64))
                sizes.append(len(by))
                left.append(known - np.arange(len(by)))
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), *[c.take(at) for c in batch.columns[:4]], pa.array(np.concatenate(left))], ["shingle", "fp", "n", "root", "out", "left"])

    return in_batches(members).select("fp", "n", "root", "out", "own").mapInArrow(first, "shingle long, fp long, n long, root long, out boolean, left long")


def apart_pairs(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: pairs of different components, one of them outside, that share one of their rarest shingles."""
    rare = stored(rarest_first(apart.join(sets, "fp").select("fp", "n", "root", "out", "own")), "rare")
    other = rare.select("shingle", F.col("fp").alias("g"), F.col("n").alias("m"), F.col("root").alias("top"), F.col("left").alias("most"))
    # From the first shingle on that both have, they can have no more in common than either has left of shingles that stand twice. Rows of later ones may fail the test; that of the first doesn't, for a pair of the similarity.
    both = F.least("left", "most")
    enough = both * SHARE[1] >= (F.col("n") + F.col("m") - both) * SHARE[0]
    pairs = rare.filter("out").join(other, "shingle").filter((F.col("root") != F.col("top")) & _alike(F.col("n"), F.col("m")) & enough)
    return pairs.select(F.least("fp", "g").alias("a"), F.greatest("fp", "g").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id_col, fp, component_id, group) as of ``simhash.near_duplicates``; texts without words are copies of each other.

    A very long text is held whole by its task, with eight bytes for each of its words; other columns of docs are ignored, so names can't clash. Results don't depend on ``hot``, but for which of
    two texts of equal similarity is verified first.
    """
    marked = stored(sketched(docs, id_col, text_col), "sketches")
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "distinct")
    worded = distinct.filter("n > 0")
    members = stored(worded.select("fp", "n", F.explode("bands").alias("band")).union(hashed(worded.select("fp", "n", "sim"))), "members")
    sizes = stored(members.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1"), "bands")
    wanted = stored(distinct.join(members.join(sizes, "band", "left_semi").select("fp").distinct(), "fp", "left_semi").select("fp", "least"), "wanted")
    # One text of each node: that of its least id, or any without an id.
    ids = wanted.select(F.col("least").alias("__id")).distinct()
    texts = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__text")).join(ids, F.col("__own").eqNullSafe(F.col("__id")), "left_semi")
    sets = stored(with_key(texts, "__own", "__text").select("fp", "own").join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    pairs, crowds = candidates(members, sizes, hot)
    pairs = stored(pairs.union(hub_pairs(crowds)).distinct(), "pairs")
    roots = simhash.components(verified(pairs, sets))
    apart = stored(left_apart(crowds, roots), "apart")
    if not apart.filter("out").isEmpty():
        more = verified(stored(apart_pairs(apart, sets), "pairs"), sets)
        # Links between components, which stand for their members.
        of = roots.select(F.col("node").alias("a"), F.col("root").alias("x"))
        ends = more.join(of, "a", "left").join(of.select(F.col("a").alias("b"), F.col("x").alias("y")), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        tops = stored(simhash.components(ends).select(F.col("node").alias("root"), F.col("root").alias("top")), "tops")
        least = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = stored(least.union(tops.select(F.col("root").alias("node"), F.col("top").alias("root"))), "roots")
    return simhash.named(marked.select("id", "fp"), distinct.select("fp", "least"), roots, id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row of each component of near copies, as ``simhash.one_of_each`` takes it."""
    return simhash.one_of_each(docs, near_copies(docs, id_col, text_col, hot), lambda d, i: with_key(d, i, text_col).select("id", "fp"), id_col)

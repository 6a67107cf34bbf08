"""Tolerant comparison of sequences, and assembly of the reads at junctions.

Comparison: a banded alignment over many pairs at once. A base that differs, a gap of one or two bases and a step over some copies of a repeat each cost a penalty that falls with the quality of the bases;
what one sequence has beyond the other's end is free.

Assembly: reads are laid by their junction, so votes for a base are counted by (junction, offset, base) over all tasks, and a deep junction is no one task's. Where a second base has enough
reads the junction's reads part into branches, round by round. Junctions that share fragments are one phase group, a component of the graph of pairs. Assemblies of a group are linked where an exact seed of
one lies in the other and the comparison of what overlaps along it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import reverse_complement
from ..storage import stored
from . import graph as G
from . import intervals as I

#: Penalties of differing bases and of gaps by the lowest quality that takes part, and the qualities up to which it is low and medium.
HIGH, MEDIUM_BASE, MEDIUM_GAP, LOW = 1.0, 0.3, 0.2, 0.0
LOW_QUALITY, MEDIUM_QUALITY = 26, 30
#: The overlap up to which a penalty is permitted; beyond the last, LONG_OVERLAP.
PERMITTED = [(5, 0.0), (15, 0.3), (49, 1.0), (99, 2.0)]
LONG_OVERLAP = 3.0
#: Copies of a repeat from which 1, 2 and 3 of them may be missing; bases of a unit; copies that make a repeat.
MISSING = [(4, 1), (11, 2), (16, 3)]
UNITS, COPIES = 3, 4
#: By the larger of two numbers of copies (255 and more are one), how many may be missing.
MAY_MISS = np.array([max((m for c, m in MISSING if n >= max(c, COPIES)), default=0) for n in range(256)], np.uint8)
GAP = 2
BAND = 12


def permitted(overlap) -> np.ndarray:
    """The penalty that sequences which overlap by so many bases may have."""
    overlap = np.asarray(overlap)
    out = np.full(overlap.shape, LONG_OVERLAP)
    for most, penalty in reversed(PERMITTED):
        out = np.where(overlap <= most, penalty, out)
    return out


def _by_quality(quality: np.ndarray, medium: float) -> np.ndarray:
    return np.where(quality <= LOW_QUALITY, LOW, np.where(quality <= MEDIUM_QUALITY, medium, HIGH))


def _copies(s: np.ndarray, unit: int) -> np.ndarray:
    """Of each position (a row for each sequence) how many whole copies of its last ``unit`` bases end there."""
    n = s.shape[1]
    run = np.zeros(s.shape, np.int64)
    for i in range(unit, n):
        run[:, i] = np.where((s[:, i] == s[:, i - unit]) & (s[:, i] > 0), run[:, i - 1] + 1, 0)
    return run // unit + 1


def penalties(a: list[bytes], qa: list[bytes], b: list[bytes], qb: list[bytes], band: int = BAND) -> tuple[np.ndarray, np.ndarray]:
    """(penalty, overlap) of pairs that begin together: the least penalty of an alignment that ends where either does, and the bases of the shorter that it takes in (least of both ends, ties the longest).

    Alignments stay within ``band`` of the diagonal.
    """
    p = len(a)
    if not p:
        return np.zeros(0), np.zeros(0, np.int64)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    # A row for each position, so that a step reads neighbouring bytes of all pairs.
    wide = lambda rows, n, fill: np.array([np.frombuffer(x.ljust(n, bytes([fill])), np.uint8) for x in rows]).reshape(p, n)
    na, nb = int(la.max()), int(lb.max())
    sa, sb = wide(a, na, 0), wide(b, nb, 0)
    ua, ub = wide(qa, na, 255).T, wide(qb, nb, 255).T
    ca, cb = [[np.minimum(_copies(s, u), 255).astype(np.uint8).T for u in range(1, UNITS + 1)] for s in (sa, sb)]
    sa, sb = np.ascontiguousarray(sa.T), np.ascontiguousarray(sb.T)
    width, far = 2 * band + 1, MISSING[-1][1] * UNITS
    # b with a margin on both sides: rows i + 1 to i + 1 + width are the bases before the diagonals of i. The penalty of the lowest quality is the least of the penalties.
    margin = lambda x, fill: np.concatenate([np.full((band + 2, p), fill, x.dtype), x, np.full((na + band + 2, p), fill, x.dtype)])
    base_a, gap_a, gap_b = _by_quality(ua, MEDIUM_BASE), np.concatenate([_by_quality(ua, MEDIUM_GAP), np.full((1, p), HIGH)]), margin(_by_quality(ub, MEDIUM_GAP), HIGH)
    base_b, letters, copies = margin(_by_quality(ub, MEDIUM_BASE), HIGH), margin(sb, 0), [margin(x, 0) for x in cb]
    of_a, of_b = ({int(n): np.flatnonzero(x == n) for n in np.unique(x)} for x in (la, lb))
    best, overlap = np.full(p, np.inf), np.zeros(p, np.int64)
    cost: dict[int, np.ndarray] = {}  # cost[i][k]: i bases of a and i + k - band of b are read
    none = np.full(p, np.inf)
    for i in range(na + 1):
        first, last = max(0, band - i), min(width - 1, nb - i + band)
        if first > last:
            break
        here = cost[i] = np.full((width, p), np.inf)
        cost.pop(i - far - 1, None)
        at, behind = slice(i + 1, i + 1 + width), gap_b[i + 2 : i + 2 + width]  # of the base of b behind each diagonal
        if i == 0:
            here[band] = 0.0
        else:
            np.add(cost[i - 1], np.where(letters[at] != sa[i - 1], np.minimum(base_b[at], base_a[i - 1]), 0.0), out=here)
        for n in range(1, min(GAP, i) + 1):
            np.minimum(here[:-n], cost[i - n][n:] + np.minimum(gap_a[i - n : i].min(0), behind[:-n]), out=here[:-n])
        before = [np.minimum(gap_b[at], gap_a[i]), np.minimum(np.minimum(gap_b[at], gap_b[i : i + width]), gap_a[i])]  # by GAP
        longer: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}  # by diagonal: steps over copies of b, which follow from the diagonals before it
        for u in range(1, min(UNITS, i) + 1):
            x, y = ca[u - 1][i - 1], copies[u - 1][at]
            many = np.maximum(x, y)
            ks, pairs = np.nonzero((x != y) & (many - np.minimum(x, y) <= MAY_MISS[many]))
            for t in range(-1, u):
                js = i + ks - band
                kept = (js >= u) & (js <= nb) if t < 0 else sa[i - 1 - t, pairs] == sb[js - 1 - t, pairs]
                ks, pairs = ks[kept], pairs[kept]
            more = x[pairs].astype(np.int64) - y[ks, pairs]
            for n in range(1, MISSING[-1][1] + 1):
                some = (more == n) & (ks + n * u < width)
                if i >= n * u and some.any():
                    k, own = ks[some], pairs[some]
                    here[k, own] = np.minimum(here[k, own], cost[i - n * u][k + n * u, own] + np.minimum(gap_a[i - n * u : i, own].min(0), gap_b[i + k + 2, own]))
                some = (more == -n) & (ks >= n * u) & (i + ks - band >= n * u)
                if some.any():
                    k, own = ks[some], pairs[some]
                    step = gap_a[i, own]
                    for t in range(n * u):
                        step = np.minimum(step, gap_b[i + k + 1 - t, own])
                    cuts = np.flatnonzero(np.diff(k)) + 1
                    for d, o, c in zip(k[[0, *cuts]], np.split(own, cuts), np.split(step, cuts)):
                        longer.setdefault(int(d), []).append((n * u, o, c))
        for k in range(first, last + 1):
            j, row = i + k - band, here[k]
            for n in range(1, GAP + 1):
                if j >= n and k >= n:
                    np.minimum(row, here[k - n] + before[n - 1][k], out=row)
            for n, own, step in longer.get(k, ()):
                row[own] = np.minimum(row[own], here[k - n, own] + step)
            ends = [x for x in (of_a.get(i), of_b.get(j)) if x is not None]
            if not ends:
                continue
            some = ends[0] if len(ends) == 1 else np.union1d(*ends)
            some = some[(i <= la[some]) & (j <= lb[some]) & (row[some] < np.inf)]
            value = row[some]
            better = (value < best[some] - 1e-12) | ((np.abs(value - best[some]) <= 1e-12) & (min(i, j) > overlap[some]))
            best[some[better]], overlap[some[better]] = value[better], min(i, j)
        here[:first], here[last + 1 :] = none, none
        here[i + np.arange(width)[:, None] - band > lb] = np.inf
        here[:, i > la] = np.inf
    return best, overlap


PAIR = 2000


def compared(pairs: DataFrame, a: str, qa: str, b: str, qb: str, band: int = BAND) -> DataFrame:
    """The pairs with ``penalty``, ``overlap`` and ``alike`` (whether that overlap permits the penalty); sequences begin together, qualities are text (33 and more).

    Null sequences are empty and overlap by nothing. Pairs are compared in batches, by length, so that the tables follow the longest of a batch.
    """
    keep = pairs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema] + ["penalty double, overlap long, alike boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [[(x or "").encode() for x in batch[c].to_pylist()] for c in (a, b)]
            marks = [[bytes(ord(c) - 33 for c in x or "") for x in batch[q].to_pylist()] for q in (qa, qb)]
            out, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            order = sorted(range(batch.num_rows), key=lambda i: len(cells[0][i]))
            lo = 0
            while lo < len(order):
                hi = lo + 1
                while hi < len(order) and hi - lo < PAIR and (hi - lo) * (len(cells[0][order[hi]]) + 1) < 400_000:
                    hi += 1
                some = order[lo:hi]
                out[some], size[some] = penalties(*[[x[i] for i in some] for x in (cells[0], marks[0], cells[1], marks[1])], band)
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array(size), pa.array(out <= permitted(size))], [*keep, "penalty", "overlap", "alike"])

    return pairs.mapInArrow(run, schema)


def nearest_known(breakends: DataFrame, known: DataFrame, distance: int = 50) -> DataFrame:
    """The breakends (chromosome, position, orientation, ...) with the known variant nearest to each within ``distance``: variant, breakend, distance; null without one.

    known: (variant, breakend, chromosome, position, orientation). Of equally near ones, that of the same orientation, then the least variant and breakend. Pairs come from a band join.
    """
    # What is nearest depends on the place alone, and of known variants at one place only the least one counts: pairs grow with places and not with rows.
    spot = ["chromosome", "position", "orientation"]
    left = breakends.select("chromosome", F.col("position").alias("__a"), F.col("position").alias("__b"), F.col("orientation").alias("__w")).distinct()
    right = known.groupBy(*spot).agg(F.min(F.struct("variant", "breakend")).alias("__k")).select("chromosome", F.col("position").alias("__p"), F.col("position").alias("__q"), F.col("orientation").alias("__o"), "__k")
    met = I.range_join(left, right, ["chromosome"], ("__a", "__b"), ("__p", "__q"), max(1, 2 * distance), slack=distance)
    choice = F.struct(F.abs(F.col("__a") - F.col("__p")).alias("distance"), (F.col("__o") != F.col("__w")).alias("o"), F.col("__k.variant").alias("variant"), F.col("__k.breakend").alias("breakend"))
    best = met.groupBy(F.col("chromosome").alias("__c"), "__a", "__w").agg(F.min(choice).alias("m")).select("__c", "__a", "__w", "m.variant", "m.breakend", "m.distance")
    same = [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(spot, ("__c", "__a", "__w"))]
    return breakends.join(best, same, "left").select(*breakends.columns, "variant", "breakend", "distance")


def seeded(rows: DataFrame, known: DataFrame, id_col: str, sequence: str, known_id: str, known_sequence: str, k: int = 20, least: int = 2) -> DataFrame:
    """(id, known id, shift, seeds): pairs that share exact seeds of k bases on one diagonal; shift is the place in the known sequence less that in the other, and of a pair the one with most seeds (ties: the least).

    The known sequences give every k-th seed only, the others all; a shared stretch of 2k - 1 bases holds one seed at least.
    """
    at = lambda c, step: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(c) - k), F.lit(step)), lambda i: F.struct(i.alias("at"), F.substring(c, i + 1, F.lit(k)).alias("seed")))
    a = rows.select(F.col(id_col).alias("id"), F.explode(at(F.col(sequence), 1)).alias("s")).select("id", F.col("s.at").alias("x"), "s.seed").filter(F.length("seed") == k)
    b = known.select(F.col(known_id).alias("other"), F.explode(at(F.col(known_sequence), k)).alias("s")).select("other", F.col("s.at").alias("y"), "s.seed").filter(F.length("seed") == k)
    met = a.join(b, "seed").groupBy("id", "other", (F.col("y") - F.col("x")).alias("shift")).agg(F.count("*").alias("seeds"))
    best = met.groupBy("id", "other").agg(F.max_by(F.struct("shift", "seeds"), F.struct("seeds", -F.col("shift"))).alias("m"))
    return best.select("id", "other", "m.shift", "m.seeds").filter(F.col("seeds") >= least)


# ---------------------------------------------------------------- assembly

#: Reads and their share that part a branch; extension lengths of the two anchor reads; reads that carry the consensus on; shared fragments of a phase group; seed and least overlap of a link.
BRANCH_READS, BRANCH_SHARE = 5, 0.2
ANCHOR, SECOND = 32, 16
CARRY = 2
SHARED_FRAGMENTS = 2
SEED, LEAST_OVERLAP = 20, 50


def laid_bases(reads: DataFrame) -> DataFrame:
    """(junction, branch, read, offset, base, quality) of reads (junction, branch, read, bases, qualities, at): offset 0 is the first base beyond the junction, which is base ``at`` of the read from 0."""
    letters = F.arrays_zip(F.split("bases", "").alias("b"), F.transform(F.split("qualities", ""), lambda q: F.ascii(q) - 33).alias("q"))
    laid = reads.select("junction", "branch", "read", "at", F.posexplode(F.filter(letters, lambda x: x["b"] != "")).alias("i", "x"))
    return laid.select("junction", "branch", "read", (F.col("i") - F.col("at")).alias("offset"), F.col("x.b").alias("base"), F.col("x.q").alias("quality"))


def branched(reads: DataFrame, least: int = BRANCH_READS, share: float = BRANCH_SHARE) -> DataFrame:
    """The reads with ``branch``, a text that says how they part: where beyond a junction a second base has ``least`` reads and ``share`` of a branch's, reads with it go to a branch of their own.

    Each round parts every branch at its one place with most reads for the second base (ties: the nearest to the junction), until none parts; votes of low quality don't count. Reads that don't reach the place stay with the first
    base. State is written between rounds; each new branch has ``least`` reads at least, so rounds are few.
    """
    state = stored(reads.withColumn("branch", F.lit("")), "branches")
    while True:
        beyond = laid_bases(state).filter((F.col("offset") >= 0) & (F.col("quality") > LOW_QUALITY))
        votes = beyond.groupBy("junction", "branch", "offset", "base").agg(F.count("*").alias("n"))
        order = Window.partitionBy("junction", "branch", "offset").orderBy(F.desc("n"), "base")
        ranked = votes.withColumn("k", F.row_number().over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("junction", "branch", "offset")))
        second = ranked.filter((F.col("k") == 2) & (F.col("n") >= F.greatest(F.lit(least), F.col("all") * share)))
        place = second.groupBy("junction", "branch").agg(F.max_by(F.struct("offset", "base"), F.struct("n", -F.col("offset"))).alias("p"))
        place = stored(place.select("junction", "branch", "p.offset", "p.base"), "places")
        if place.isEmpty():
            return state
        met = state.join(place, ["junction", "branch"], "left")
        own = F.substring("bases", (F.col("at") + F.col("offset") + 1).cast("int"), F.lit(1))
        good = F.ascii(F.substring("qualities", (F.col("at") + F.col("offset") + 1).cast("int"), F.lit(1))) - 33 > LOW_QUALITY
        goes = F.col("offset").isNotNull() & good & (own == F.col("base"))
        name = F.when(goes, F.concat("branch", F.lit("/"), F.col("offset").cast("string"), "base")).when(F.col("offset").isNotNull(), F.concat("branch", F.lit("/"), F.col("offset").cast("string"), F.lit("-"))).otherwise(F.col("branch"))
        state = stored(met.withColumn("branch", name).select(*state.columns), "branches")


def consensus(reads: DataFrame, carry: int = CARRY) -> DataFrame:
    """(junction, branch, sequence, qualities, junction_at, reads): by offset the base with the most quality (ties: the least base), outwards from the junction in both directions as long as ``carry`` reads go on.

    A base's quality is the highest of the reads that vote for it.
    """
    votes = laid_bases(reads).groupBy("junction", "branch", "offset", "base").agg(F.sum("quality").alias("weight"), F.max("quality").alias("quality"), F.count("*").alias("n"))
    best = votes.groupBy("junction", "branch", "offset").agg(F.max_by(F.struct("base", "quality"), F.struct("weight", -F.ascii("base"))).alias("m"), F.sum("n").alias("n")).filter(F.col("n") >= carry)
    # Gapless runs of offsets on either side of the junction.
    right = Window.partitionBy("junction", "branch", F.col("offset") >= 0).orderBy("offset")
    left = Window.partitionBy("junction", "branch", F.col("offset") >= 0).orderBy(F.desc("offset"))
    step = F.when(F.col("offset") >= 0, F.row_number().over(right) - 1).otherwise(-F.row_number().over(left))
    gapless = best.withColumn("step", step).filter(F.col("step") == F.col("offset"))
    parts = gapless.groupBy("junction", "branch").agg(F.array_sort(F.collect_list(F.struct("offset", "m.base", "m.quality"))).alias("x"))
    made = parts.select("junction", "branch", F.array_join(F.transform("x", lambda y: y["base"]), "").alias("sequence"), F.array_join(F.transform("x", lambda y: F.char(y["quality"] + 33)), "").alias("qualities"), F.size(F.filter("x", lambda y: y["offset"] < 0)).alias("junction_at"))
    return made.join(reads.groupBy("junction", "branch").agg(F.count("*").alias("reads")), ["junction", "branch"])


def assembled(reads: DataFrame, anchor: int = ANCHOR, second: int = SECOND, band: int = BAND) -> DataFrame:
    """(junction, branch, sequence, qualities, junction_at, support, fragments) of reads (junction, read, fragment, bases, qualities, at), all in the direction in which their junction is crossed.

    A branch needs one read that goes ``anchor`` bases beyond the junction and one of another fragment that goes ``second``. Support are the reads whose part beyond the junction is alike the assembly's. Reads with null bases
    or qualities don't count.
    """
    known = reads.filter("bases IS NOT NULL AND qualities IS NOT NULL")
    parted = stored(branched(known), "parted")
    beyond = F.length("bases") - F.col("at")
    long = parted.groupBy("junction", "branch").agg(F.max(F.when(beyond >= anchor, beyond)).alias("far"), F.count_distinct(F.when(beyond >= second, F.col("fragment"))).alias("fragments")).filter("far IS NOT NULL AND fragments >= 2")
    made = consensus(parted.join(long.select("junction", "branch"), ["junction", "branch"], "left_semi"))
    cut = lambda c, at: F.substring(c, (at + 1).cast("int"), F.length(c))
    both = parted.join(made.select("junction", "branch", cut("sequence", F.col("junction_at")).alias("__s"), cut("qualities", F.col("junction_at")).alias("__q")), ["junction", "branch"])
    pairs = both.select("junction", "branch", "read", "fragment", cut("bases", F.col("at")).alias("__r"), cut("qualities", F.col("at")).alias("__u"), "__s", "__q")
    held = compared(pairs, "__r", "__u", "__s", "__q", band).filter("alike").groupBy("junction", "branch").agg(F.count("*").alias("support"), F.count_distinct("fragment").alias("fragments"))
    return made.drop("reads").join(held, ["junction", "branch"])


def phase_groups(reads: DataFrame, least: int = SHARED_FRAGMENTS) -> DataFrame:
    """(junction, group) of reads (junction, fragment): junctions that share ``least`` fragments, directly or over others, are in one group, named by its least junction; junctions are long.

    A fragment's junctions are tied to the next one by number only where that is enough: pairs are counted over fragments, of which each has a few junctions.
    """
    own = reads.select("junction", "fragment").distinct()
    pairs = own.join(own.withColumnRenamed("junction", "other"), "fragment").filter("junction < other").groupBy("junction", "other").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    found = G.components(pairs, "junction", "other")
    return own.select("junction").distinct().join(found, F.col("junction") == F.col("node"), "left").select("junction", F.coalesce("root", "junction").alias("group"))


def linked(assemblies: DataFrame, groups: DataFrame, seed: int = SEED, least: int = LEAST_OVERLAP, band: int = BAND) -> DataFrame:
    """(a, b, turned, overlap, penalty): assemblies (id, junction, sequence, qualities) of one phase group (junction, group) that overlap by ``least`` bases and are alike along a seed; turned: b is read backwards. Of a pair, the longest overlap.

    Seeds meet within a group only.
    """
    rows = assemblies.join(groups, "junction").select("id", "group", "sequence", "qualities")
    every = rows.select("id", "group", "sequence", "qualities", F.lit(False).alias("turned")).union(rows.select("id", "group", reverse_complement(F.col("sequence")), F.reverse("qualities"), F.lit(True)))
    seeds = lambda step: F.transform(F.sequence(F.lit(0), F.length("sequence") - seed, F.lit(step)), lambda i: F.struct(i.alias("at"), F.substring(F.col("sequence"), i + 1, F.lit(seed)).alias("seed")))
    long = F.length("sequence") >= seed
    a = rows.filter(long).select("group", F.col("id").alias("a"), F.explode(seeds(1)).alias("s")).select("group", "a", F.col("s.at").alias("x"), "s.seed")
    b = every.filter(long).select("group", F.col("id").alias("b"), "turned", F.explode(seeds(seed)).alias("s")).select("group", "b", "turned", F.col("s.at").alias("y"), "s.seed")
    shifts = a.join(b, ["group", "seed"]).filter("a < b").groupBy("a", "b", "turned", (F.col("x") - F.col("y")).alias("shift")).agg(F.count("*").alias("seeds"))
    one = shifts.groupBy("a", "b", "turned").agg(F.max_by("shift", F.struct("seeds", -F.col("shift"))).alias("shift"))
    met = one.join(rows.select(F.col("id").alias("a"), F.col("sequence").alias("__s"), F.col("qualities").alias("__q")), "a").join(every.select(F.col("id").alias("b"), "turned", F.col("sequence").alias("__t"), F.col("qualities").alias("__u")), ["b", "turned"])
    cut = lambda c, n: F.substring(c, (F.greatest(F.lit(0), n) + 1).cast("int"), F.length(c))
    pairs = met.select("a", "b", "turned", cut("__s", F.col("shift")).alias("__s"), cut("__q", F.col("shift")).alias("__q"), cut("__t", -F.col("shift")).alias("__t"), cut("__u", -F.col("shift")).alias("__u"))
    good = compared(pairs, "__s", "__q", "__t", "__u", band).filter(F.col("alike") & (F.col("overlap") >= least))
    return good.groupBy("a", "b").agg(F.max_by(F.struct("turned", "overlap", "penalty"), F.struct("overlap", -F.col("penalty"), ~F.col("turned"))).alias("m")).select("a", "b", "m.*")

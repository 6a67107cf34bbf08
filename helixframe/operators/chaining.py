"""Chains of structural variants with copy numbers, and rings among them.

Variants of a cluster are joined at breakends that face each other: a lower one from which the sequence goes on upwards and an upper one from which it goes on downwards. Each chain has a copy number, at first that of its one
variant. The next link is always that of the highest rules, and where chains differ in copy number the larger one is parted: the copies that are left over stay a chain of their own, so a breakend may be linked more
than once. Two links at once are made where a foldback's both ends meet one end of a chain of twice its copies, which then stands on both sides of it, and where a duplication's ends meet both ends of such a chain.

Clusters are groups of one sample's variants that were built to be resolved together; they are dealt over the tasks. Within one, work is the square of its open ends for each link.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the rules, whose sum decides.
RULES = {"ASSEMBLY": 0, "ONLY": 8, "FOLDBACK_SPLIT": 7, "COMP_DUP_SPLIT": 7, "FOLDBACK": 6, "JCN_MATCH": 5, "JCN_OVERLAP": 4, "ADJACENT": 3, "JCN_MAX": 2, "NEAREST": 1}
#: What a rule adds to an option's weight, and the rule of each weight's highest bit among those of single links.
WEIGHTS = {name: 2**k for name, k in RULES.items()}
_HIGHEST = {k + 1: name for name, k in RULES.items() if name not in ("FOLDBACK_SPLIT", "COMP_DUP_SPLIT")} | {0: "NEAREST"}
#: The largest weight of an option of two links; they aren't looked for where a single one has more.
TWO_LINKS = WEIGHTS["FOLDBACK_SPLIT"] + WEIGHTS["JCN_MATCH"]
#: The least length of a segment between two breakends that isn't assembled; copy numbers are equal within the larger of these.
LEAST_LENGTH = 30
ABSOLUTE, RELATIVE = 0.5, 0.15
#: Fixed values of rings: copies that one variant must have, that all must have, times the copies beside them, share of the highest, least length of a ring.
RING_ONE, RING_ALL, RING_TIMES, RING_SHARE, RING_LENGTH = 8.0, 5.0, 2.0, 0.25, 1500


class End(NamedTuple):
    variant: int
    side: int
    chromosome: str
    position: int
    orientation: int


@dataclass
class Chain:
    """Variants in order, each with the side at which it is entered; ends are None beyond a single breakend."""

    steps: list[tuple[int, int]]
    copies: float
    spread: float = 0.0
    rules: list[str] = field(default_factory=list)
    closed: bool = False

    def turned(self) -> Chain:
        return Chain([(v, 1 - side) for v, side in reversed(self.steps)], self.copies, self.spread, self.rules[::-1], self.closed)

    def part(self, copies: float) -> Chain:
        return Chain(list(self.steps), copies, self.spread, list(self.rules), self.closed)


def faces(a: End, b: End, least: int = LEAST_LENGTH) -> bool:
    """Whether a segment from the lower of both to the upper one can lie between them."""
    low, high = (a, b) if (a.position, -a.orientation) <= (b.position, -b.orientation) else (b, a)
    return a.chromosome == b.chromosome and low.orientation == -1 and high.orientation == 1 and high.position - low.position >= least


def equal(a: float, b: float, spread: float = 0.0) -> bool:
    gap = abs(a - b)
    return gap <= ABSOLUTE or gap <= RELATIVE * (a if a > b else b) or gap <= spread


class Cluster:
    """The chains of one cluster; ends: of each variant its breakends by side, missing ones left out."""

    def __init__(self, ends: dict[int, dict[int, End]], copies: dict[int, float], spreads: dict[int, float] | None = None):
        self.ends, self.spreads = ends, spreads or {}
        self.chains = [Chain([(v, 0)], copies[v], self.spreads.get(v, 0.0)) for v in sorted(ends) if copies[v] > 0]
        self.positions = sorted((e.chromosome, e.position, e.variant) for own in ends.values() for e in own.values())

    def open(self, chain: Chain, last: bool) -> End | None:
        """The free breakend before the first or behind the last variant."""
        if chain.closed:
            return None
        v, entered = chain.steps[-1 if last else 0]
        return self.ends[v].get(1 - entered if last else entered)

    def directed(self, chain: Chain, last: bool) -> Chain:
        """The chain so that its given end comes last."""
        return chain if last else chain.turned()

    def folds(self, chain: Chain) -> bool:
        """Whether both ends look the same way with no other variant's breakend between them."""
        a, b = self.open(chain, False), self.open(chain, True)
        if a is None or b is None or a.chromosome != b.chromosome or a.orientation != b.orientation:
            return False
        own = {v for v, _ in chain.steps}
        lo, hi = sorted((a.position, b.position))
        return not any(c == a.chromosome and lo < p < hi and v not in own for c, p, v in self.positions)

    # Joining.

    def replace(self, gone: list[Chain], made: list[Chain]) -> None:
        self.chains = [c for c in self.chains if not any(c is g for g in gone)] + made

    def join(self, x: Chain, x_last: bool, y: Chain, y_last: bool, rule: str) -> None:
        """One link; what the larger one has more stays."""
        spread = max(x.spread, y.spread)
        same = equal(x.copies, y.copies, spread)
        copies = (x.copies + y.copies) / 2 if same else min(x.copies, y.copies)
        a, b = self.directed(x, x_last), self.directed(y, not y_last)
        made = [Chain(a.steps + b.steps, copies, spread, [*a.rules, rule, *b.rules])]
        if not same:
            more = x if x.copies > y.copies else y
            made.append(more.part(more.copies - copies))
        self.replace([x, y], made)

    def fold(self, y: Chain, y_last: bool, x: Chain, rule: str) -> None:
        """Two links: y, the foldback x, and y backwards."""
        rest = y.copies - 2 * x.copies
        a = self.directed(y, y_last)
        made = [Chain(a.steps + x.steps + a.turned().steps, x.copies, max(x.spread, y.spread), [*a.rules, rule, *x.rules, rule, *a.rules[::-1]])]
        if not equal(y.copies, 2 * x.copies, y.spread):
            made.append(y.part(rest))
        self.replace([x, y], made)

    def duplicate(self, y: Chain, x: Chain, turned: bool, rule: str) -> None:
        """Two links: y, the duplication x, and y again."""
        b = x.turned() if turned else x
        rest = y.copies - 2 * x.copies
        made = [Chain(y.steps + b.steps + y.steps, x.copies, max(x.spread, y.spread), [*y.rules, rule, *b.rules, rule, *y.rules])]
        if not equal(y.copies, 2 * x.copies, y.spread):
            made.append(y.part(rest))
        self.replace([x, y], made)

    # Choosing.

    def free(self) -> list[tuple[Chain, bool, End]]:
        out = []
        for c in self.chains:
            if not c.closed:
                (v, entered), (w, at) = c.steps[0], c.steps[-1]
                if (e := self.ends[v].get(entered)) is not None:
                    out.append((c, False, e))
                if (e := self.ends[w].get(1 - at)) is not None:
                    out.append((c, True, e))
        return out

    def assemble(self, links: list[tuple[tuple[int, int], tuple[int, int]]]) -> None:
        """Links that were read from assemblies come first, the shortest of them before others; a breakend that is tied to both ends of a foldback is tied to them at once."""
        where = {(v, s): e for v, own in self.ends.items() for s, e in own.items()}
        links = sorted({tuple(sorted(x)) for x in links if x[0] in where and x[1] in where}, key=lambda x: (abs(where[x[0]].position - where[x[1]].position), x))
        done: set[tuple] = set()
        for a, b in links:
            if (a, b) in done:
                continue
            for one, other in ((a, b), (b, a)):
                twin = tuple(sorted((one, (other[0], 1 - other[1]))))
                if twin in links and twin not in done and other[0] != one[0]:
                    x = self._at(other)
                    y = self._at(one)
                    if x and y and x[0] is not y[0] and len(x[0].steps) == 1 and y[0].copies >= 2 * x[0].copies - ABSOLUTE:
                        self.fold(y[0], y[1], x[0], "ASSEMBLY")
                        done |= {(a, b), twin}
                        break
            else:
                x, y = self._at(a), self._at(b)
                if x and y and x[0] is not y[0]:
                    self.join(x[0], x[1], y[0], y[1], "ASSEMBLY")
                done.add((a, b))

    def _at(self, end: tuple[int, int]) -> tuple[Chain, bool] | None:
        """The chain of most copies with this breakend free, and whether it is its last."""
        found = [(c, last) for c, last, e in self.free() if (e.variant, e.side) == end]
        return max(found, key=lambda x: x[0].copies, default=None)

    def step(self) -> bool:
        """The best link, or pair of links, if there is any."""
        free = self.free()
        pairs = []
        for i, x in enumerate(free):
            chain, _, (_, _, chromosome, position, orientation) = x
            for y in free[i + 1 :]:
                e = y[2]
                # As faces has it.
                if e.orientation * orientation == -1 and (e.position - position) * e.orientation >= LEAST_LENGTH and e.chromosome == chromosome and y[0] is not chain:
                    pairs.append((x, y))
        if not pairs:
            return False
        partners: dict[tuple[int, int], set[tuple[int, int]]] = {}
        spots: dict[str, list[int]] = {}
        most = float("-inf")
        for (x, _, a), (y, _, b) in pairs:
            partners.setdefault(a[:2], set()).add(b[:2])
            partners.setdefault(b[:2], set()).add(a[:2])
            most = max(most, x.copies, y.copies)
        for _, _, e in free:
            spots.setdefault(e.chromosome, []).append(e.position)
        for own in spots.values():
            own.sort()
        best = None

        def offered(weight: int, length: int, choice: tuple, rule: str | None, a: End, b: End) -> None:
            """Keep the option of the largest weight, then the least length, then the least ids; the first of equal ones."""
            nonlocal best
            if best is None or weight > best[0] or (weight == best[0] and (length < best[1] or (length == best[1] and sorted((a[:2], b[:2])) < sorted(best[4])))):
                best = (weight, length, choice, rule, (a[:2], b[:2]))

        for x, y in pairs:
            a, b = x[2], y[2]
            weight = 0
            if len(partners[a[:2]]) == 1 or len(partners[b[:2]]) == 1:
                weight += WEIGHTS["ONLY"]
            if equal(x[0].copies, y[0].copies):
                weight += WEIGHTS["JCN_MATCH"]
            elif equal(x[0].copies, y[0].copies, x[0].spread + y[0].spread):
                weight += WEIGHTS["JCN_OVERLAP"]
            lo, hi = (a.position, b.position) if a.position < b.position else (b.position, a.position)
            own = spots[a.chromosome]
            if bisect_right(own, lo) >= bisect_left(own, hi):
                weight += WEIGHTS["ADJACENT"]
            if x[0].copies == most or y[0].copies == most:
                weight += WEIGHTS["JCN_MAX"]
            offered(weight, hi - lo, ("join", x, y), None, a, b)
        if best[0] <= TWO_LINKS:
            self._two_links(pairs, offered)
        weight, _, choice, rule, _ = best
        rule = rule or _HIGHEST[weight.bit_length()]
        if choice[0] == "join":
            _, x, y = choice
            self.join(x[0], x[1], y[0], y[1], rule)
        elif choice[0] == "fold":
            _, y, x = choice
            self.fold(y[0], y[1], x[0], rule)
        else:
            _, y, x, turned = choice
            self.duplicate(y[0], x[0], turned, rule)
        return True

    def _two_links(self, pairs: list, offered) -> None:
        """The options of two links at once."""
        by_chain: dict[int, list] = {}
        for x, y in pairs:
            by_chain.setdefault(id(x[0]), []).append((x, y))
            by_chain.setdefault(id(y[0]), []).append((y, x))
        for own in by_chain.values():
            chain = own[0][0][0]
            folds = self.folds(chain)
            ends = [self.open(chain, False), self.open(chain, True)]
            for x, y in own:
                other = y[0]
                exact = equal(other.copies, 2 * chain.copies)
                if not exact and not folds:
                    continue
                if folds and all(e is not None and faces(e, y[2]) for e in ends) and (exact or other.copies > 2 * chain.copies):
                    rule = "FOLDBACK_SPLIT" if exact else "FOLDBACK"
                    offered(WEIGHTS[rule] + (WEIGHTS["JCN_MATCH"] if exact else 0), min(abs(e.position - y[2].position) for e in ends), ("fold", y, x), rule, x[2], y[2])
                first, last = self.open(other, False), self.open(other, True)
                if exact and not folds and None not in (first, last, *ends) and len({e.orientation for e in ends}) == 2:
                    for turned in (False, True):
                        enter, leave = ends[::-1] if turned else ends
                        if faces(last, enter) and faces(leave, first):
                            offered(WEIGHTS["COMP_DUP_SPLIT"] + WEIGHTS["JCN_MATCH"], abs(last.position - enter.position), ("duplicate", y, x, turned), "COMP_DUP_SPLIT", x[2], y[2])

    def resolve(self, assembled: list | None = None) -> list[Chain]:
        if assembled:
            self.assemble(assembled)
        while self.step():
            pass
        return sorted(self.chains, key=lambda c: (-len(c.steps), c.steps))

    def close(self) -> None:
        """Close the chains whose ends face each other."""
        for c in self.chains:
            a, b = self.open(c, False), self.open(c, True)
            if a is not None and b is not None and faces(a, b):
                c.closed = True
                c.rules.append("CLOSE")

    def links(self, chain: Chain) -> list[tuple[End, End, str]]:
        around = [*chain.steps, chain.steps[0]] if chain.closed else chain.steps
        return [(self.ends[v][1 - s], self.ends[w][t], rule) for (v, s), (w, t), rule in zip(around, around[1:], chain.rules)]


def _ends(rows: list[dict]) -> dict[int, dict[int, End]]:
    out: dict[int, dict[int, End]] = {}
    for r in rows:
        own = out.setdefault(r["variant"], {})
        for side, c, p, o in ((0, r["chromosome_start"], r["position_start"], r["orientation_start"]), (1, r["chromosome_end"], r["position_end"], r["orientation_end"])):
            if c is not None and p is not None:
                own[side] = End(r["variant"], side, str(c), p, o)
    return out


CHAINS = "chain int, copies double, closed boolean, links int, variants int, path string"
LINKS = "chain int, at int, a_variant long, a_side int, b_variant long, b_side int, chromosome string, low long, high long, rule string, copies double"


def _distinct(rows: list[dict]) -> list[dict]:
    """One row for each variant: the first in the order of its values."""
    if len({r["variant"] for r in rows}) == len(rows):
        return rows
    out: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: [(v is not None, v) for v in r.values()]):
        out.setdefault(r["variant"], r)
    return list(out.values())


def _resolved(rows: list[dict], assembled: list[dict]) -> tuple[Cluster, list[Chain]]:
    rows = _distinct(rows)
    cluster = Cluster(_ends(rows), {r["variant"]: r["copies"] or 0.0 for r in rows}, {r["variant"]: r["spread"] or 0.0 for r in rows})
    return cluster, cluster.resolve([((r["a_variant"], r["a_side"]), (r["b_variant"], r["b_side"])) for r in assembled])


def path_of(chain: Chain) -> str:
    """Variants in order, with ``-`` before those that are entered at their end."""
    return ",".join(("-" if s else "") + str(v) for v, s in chain.steps)


COLUMNS = ["variant", *[f"{x}_{y}" for y in ("start", "end") for x in ("chromosome", "position", "orientation")], "copies", "spread"]


def _grouped(variants: DataFrame, assembled: DataFrame | None, by: list[str], make, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """What ``make`` gives for each cluster, which is one row of lists; a task takes many."""
    keys = ", ".join(f"`{k}` {variants.schema[k].dataType.simpleString()}" for k in by)
    rows = variants.select(*by, F.struct(F.col("variant").cast("long").alias("variant"), *COLUMNS[1:], *more).alias("v")).groupBy(*by).agg(F.collect_list("v").alias("v"))
    if assembled is None:
        rows = rows.withColumn("l", F.array())
    else:
        links = assembled.select(*by, F.struct("a_variant", "a_side", "b_variant", "b_side").alias("l")).groupBy(*by).agg(F.collect_list("l").alias("l"))
        rows = rows.join(links, by, "left")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = _arrow_kinds(f"{keys}, {schema}")
    fields = [*COLUMNS, *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Columns become values at once, and rows from them; a struct turned into a value by itself takes longer than its cluster's work.
            lists = batch.column("v")
            flat = lists.flatten()
            each = zip(*[flat.field(f).to_pylist() for f in fields])
            own = zip(*[batch.column(k).to_pylist() for k in by])
            out = [(*k, *r) for k, n, links in zip(own, lists.value_lengths().to_pylist(), batch.column("l").to_pylist()) for r in make([dict(zip(fields, v)) for v in islice(each, n)], links or [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], [*by, *names])

    return rows.select(*by, "v", "l").mapInArrow(run, f"{keys}, {schema}")


def _arrow_kinds(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema)]


def chains(variants: DataFrame, by: list[str], assembled: DataFrame | None = None) -> DataFrame:
    """(by, chain, copies, closed, links, variants, path) of variants (by, variant, chromosome_start, position_start, orientation_start, the same of _end, copies, spread); single variants too.

    assembled: (by, a_variant, a_side, b_variant, b_side) with side 0 for starts. An end without chromosome is none. Null copies are zero, and such variants stay out; of repeated variants the first
    by its values counts. Links are chosen by the sum of their rules' weights, then by length, then by ids, so the result follows from the rows alone.
    """

    def make(rows, links):
        cluster, found = _resolved(rows, links)
        return [(i, c.copies, c.closed, len(cluster.links(c)), len({v for v, _ in c.steps}), path_of(c)) for i, c in enumerate(found)]

    return _grouped(variants, assembled, by, make, CHAINS)


def chain_links(variants: DataFrame, by: list[str], assembled: DataFrame | None = None) -> DataFrame:
    """(by, chain, at, a_variant, a_side, b_variant, b_side, chromosome, low, high, rule, copies): the links of ``chains`` in order."""

    def make(rows, links):
        cluster, found = _resolved(rows, links)
        return [(i, k, a.variant, a.side, b.variant, b.side, a.chromosome, min(a.position, b.position), max(a.position, b.position), rule, c.copies) for i, c in enumerate(found) for k, (a, b, rule) in enumerate(cluster.links(c))]

    return _grouped(variants, assembled, by, make, LINKS)


def rings(variants: DataFrame, by: list[str]) -> DataFrame:
    """(by, chain, copies, links, variants, path, length): closed walks over amplified variants, as ``chains`` takes them with beside_start and beside_end, the copies of the larger allele beside their breakends.

    A variant takes part with RING_ALL copies, RING_SHARE of the highest's, and RING_TIMES those beside one of its ends; one at least needs RING_ONE. They are chained as if all had the same copies, and chains whose ends face each
    other are closed. A ring of one variant is a duplication beyond both sides; a ring has RING_LENGTH bases at least. A null beside counts as zero.
    """
    times = lambda c: F.col("copies") >= RING_TIMES * F.coalesce(F.col(c), F.lit(0.0))
    able = variants.withColumn("__both", times("beside_start") & times("beside_end")).filter((F.col("copies") >= RING_ALL) & (times("beside_start") | (times("beside_end") & F.col("chromosome_end").isNotNull())))

    def make(rows, _):
        top = max(r["copies"] for r in rows)
        rows = _distinct([r for r in rows if r["copies"] >= RING_SHARE * top])
        if top < RING_ONE:
            return []
        own = {r["variant"]: (r["copies"], r["__both"]) for r in rows}
        cluster = Cluster(_ends(rows), dict.fromkeys(own, 1.0))
        cluster.resolve()
        cluster.close()
        out = []
        for i, c in enumerate(sorted(cluster.chains, key=lambda c: (-len(c.steps), c.steps))):
            if not c.closed or (len(c.steps) == 1 and not own[c.steps[0][0]][1]):
                continue
            length = sum(abs(a.position - b.position) for a, b, _ in cluster.links(c))
            if length >= RING_LENGTH:
                out.append((i, sum(own[v][0] for v, _ in c.steps) / len(c.steps), len(cluster.links(c)), len(c.steps), path_of(c), length))
        return out

    return _grouped(able, None, by, make, "chain int, copies double, links int, variants int, path string, length long", ("__both",))

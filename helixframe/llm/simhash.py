"""SimHash near-duplicates by multi-index hashing.

A fingerprint takes the XXH64 hashes of a text's word shingles, repeats included; a bit is set
if more than half of the hashes set it. Distinct fingerprints are linked when at most two bits differ.

Candidates: a fingerprint is cut into two 32-bit segments, and of two differing bits at most one can lie in some
segment. Each segment's Hamming ball of radius one is enumerated upwards only (the key itself
and each zero bit set), since one of two segments that differ in one bit has a zero there. A table
of segments is looked up by key, and the complete distance is verified.

Where a key holds more than ``HOT`` fingerprints (near copies of one text), pairs would grow with the
square of the group. Those keys take a second level: the rest of the fingerprint is
enumerated as well. Members that agree in the key meet at a common rest at distance one at most from both; members at distance one
in the key must agree in the rest up to one bit. Rows stay proportional to the
fingerprints, no link is lost, and both levels verify complete distances.

Components of the links are those of the library's graph operators: star contraction, every round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from . import words as W
from .common import blocks, fresh, in_batches, stored, utf8

HOT = 256
BITS = 2
SEGMENT = (1 << 32) - 1


def shingle_hashes(data: np.ndarray, at: np.ndarray, k: int, seed: int = 42) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, the hashes of their shingles of k words, repeats included, and where each row's begin; fewer words make one shingle."""
    for lo, hi, raw, where in blocks(data, at):
        low = W.LOWER[raw]
        found = W.split(low, where, W.SOLID)
        if not len(found.starts):
            continue
        solid = W.SOLID[low]
        after = np.zeros(len(low), bool)
        after[1:] = ~solid[1:] & solid[:-1]
        low = np.where(after, np.uint8(32), low)
        keep = solid | after
        place = np.zeros(len(low) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        text = low[keep].tobytes()
        starts, ends = place[found.starts], place[found.ends]
        counts = found.counts()
        full = np.flatnonzero(found.row[: len(starts) - k + 1] == found.row[k - 1 :]) if len(starts) >= k else np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        a = np.concatenate([starts[full], starts[found.first[short]]])
        b = np.concatenate([ends[full + k - 1], ends[found.first[short + 1] - 1]])
        row = np.concatenate([found.row[full], short])
        order = np.argsort(row, kind="stable")
        a, b, row = a[order], b[order], row[order]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(text[x:y], seed) for x, y in zip(a.tolist(), b.tolist())], np.uint64)
        yield lo, hi, hashes, np.searchsorted(row, np.arange(hi - lo + 1))


def fingerprints(data: np.ndarray, at: np.ndarray, k: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprint of each row of ``data``; rows without words get zero."""
    out = np.zeros(len(at) - 1, np.uint64)
    for lo, hi, hashes, edge in shingle_hashes(data, at, k, seed):
        row = np.repeat(np.arange(hi - lo), np.diff(edge))
        set_bits = np.zeros((hi - lo, 64), np.int64)
        some = np.flatnonzero(np.diff(edge))
        for c in range(0, len(some), 512):
            part = some[c : c + 512]
            x, y = edge[part[0]], edge[part[-1] + 1]
            for z in range(x, y, 1 << 18):  # a long text in pieces
                e = min(y, z + (1 << 18))
                bits = np.unpackbits(hashes[z:e].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                rows, begin = np.unique(row[z:e], return_index=True)
                set_bits[rows] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        ones = set_bits * 2 > np.diff(edge)[:, None]
        out[lo:hi] = np.packbits(ones, axis=1, bitorder="little").reshape(-1, 8).view(np.uint64).ravel()
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(data, at, k).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _ball(value: Column, bits: int = 32) -> Column:
    """The value and what is made of it by setting one of its zero bits."""
    flips = F.array(*[F.lit(1 << i) for i in range(bits)])
    return F.concat(F.array(value), F.transform(F.filter(flips, lambda m: value.bitwiseAND(m) == 0), lambda m: value.bitwiseOR(m)))


def _around(value: Column, bits: int = 32) -> Column:
    """The value and its neighbours at distance one."""
    return F.transform(F.array(F.lit(0), *[F.lit(1 << i) for i in range(bits)]), lambda m: value.bitwiseXOR(m.cast("long")))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): all pairs that must be joined so that fingerprints at distance two or less are connected; column fp, distinct.

    Below ``hot`` fingerprints a key, all pairs; above, each meeting point links its members to its least one.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(SEGMENT)), F.shiftrightunsigned("fp", 32)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("key"), high.alias("rest")), F.struct(F.lit(1).alias("seg"), high.alias("key"), low.alias("rest"))))
    segments = fps.select("fp", sides.alias("s")).select("fp", "s.seg", "s.key", "s.rest")
    heavy = segments.groupBy("seg", "key").count().filter(F.col("count") > hot).select("seg", "key", F.lit(True).alias("heavy"))
    probes = segments.select("seg", F.explode(_ball(F.col("key"))).alias("key"), F.col("fp").alias("a"), F.col("rest").alias("a_rest"))
    if not heavy.isEmpty():
        table = segments.join(heavy, ["seg", "key"], "left_anti")
        hot_table = segments.join(heavy, ["seg", "key"], "left_semi")
        hot_probes = segments.select("seg", F.explode(_ball(F.col("key"))).alias("at"), "fp", "key", "rest").join(heavy.withColumnRenamed("key", "at"), ["seg", "at"], "left_semi")
        # One bit differs in the key: the rests differ in one at most.
        one = hot_probes.filter("at != key").select("seg", F.col("at").alias("key"), F.explode(_around(F.col("rest"))).alias("rest"), F.col("fp").alias("a"))
        apart = one.join(hot_table.withColumnRenamed("fp", "b"), ["seg", "key", "rest"]).select("a", "b")
        # The keys agree: both rests lie within one bit of a meeting point, and its least member stands for it.
        met = hot_table.select("seg", "key", F.explode(_around(F.col("rest"))).alias("rest"), "fp")
        least = met.groupBy("seg", "key", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).filter("a != most").drop("most")
        near = met.join(least, ["seg", "key", "rest"]).select("a", F.col("fp").alias("b")).distinct()
        more = apart.union(near)
    else:
        table, more = segments, None
    pairs = probes.join(table.select("seg", "key", F.col("fp").alias("b")), ["seg", "key"]).select("a", "b")
    pairs = pairs if more is None else pairs.union(more)
    return pairs.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node connected to node; for nodes on an edge of (a, b)."""
    return graph.components(edges, "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id_col, fp long, component_id, group): component_id is the least id reachable over links, the row's own included; group is a fingerprint that names the component.

    Null or wordless texts have fingerprint zero, linked like any other; fewer than three words make one
    shingle. A text is held whole by its task. Repeated ids and rows give a row each; a null id is never a component's name unless no other is there. An empty table gives no rows;
    other columns are ignored.
    """
    marked = stored(with_fingerprint(docs, id_col, text_col), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    return named(marked, distinct, components(links(distinct.select("fp"), hot)), id_col)


def named(marked: DataFrame, distinct: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """(id_col, fp, component_id, group) of marked (id, fp), its distinct (fp, least id) and the components (node, root) of linked fps."""
    by_root = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = by_root.groupBy("root").agg(F.min("least").alias("component_id"))
    # Over another spelling of the key: a large component's rows are then an exchange of their own, which adaptive execution can split.
    other = F.bitwise_not("root")
    by_fp = by_root.withColumn("__k", other).join(names.select(other.alias("__k"), "component_id"), "__k").select("fp", "component_id", F.col("root").alias("group"))
    return marked.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "group")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row of each component, as ``one_of_each`` takes it."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, hot), lambda d, i: with_fingerprint(d, i, text_col), id_col)


def one_of_each(docs: DataFrame, marked: DataFrame, keyed: Callable[[DataFrame, str], DataFrame], id_col: str = "doc_id") -> DataFrame:
    """One row of each component of ``marked``, that of the least id, with its own columns; texts are shuffled once, or not at all where Spark finds the ids small.

    ``keyed`` gives (id, fp) of docs and a column to carry as id. The row is chosen by id and fingerprint, as one id may stand on unlike
    texts; rows that share both are told apart by nothing, and one of them stays. Of components without any id, the row of the least
    fingerprint stays.
    """
    marked = stored(marked.select(F.col(id_col).alias("id"), "fp", "group"), "components")
    none, least, key, own, own_key, row = fresh(docs, "__none", "__id", "__fp", "__own", "__key", "__row")
    first = F.min(F.struct(F.col("id").isNull().alias(none), F.col("id").alias(least), F.col("fp").alias(key))).alias("k")
    kept = stored(marked.groupBy("group").agg(first).select(f"k.{least}", f"k.{key}"), "kept")
    often = marked.groupBy(F.col("id").alias(own)).agg(F.count("*").alias("n")).filter(f"n > 1 OR `{own}` IS NULL").select(own)
    shared = F.col(least).eqNullSafe(F.col(own))
    out = docs.join(kept.join(often, shared, "left_anti").select(F.col(least).alias(id_col)), id_col, "left_semi").select(*docs.columns)
    more = kept.join(often, shared, "left_semi")
    if not more.isEmpty():
        some = docs.join(more.select(least).distinct(), F.col(id_col).eqNullSafe(F.col(least)), "left_semi")
        rows = keyed(some.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in some.columns])), row).select(F.col("id").alias(row), F.col("fp").alias(own_key))
        # A fingerprint is in one component, which keeps one row.
        found = rows.join(more, (F.col(own_key) == F.col(key)) & F.col(f"{row}.`{id_col}`").eqNullSafe(F.col(least)), "left_semi").dropDuplicates([own_key])
        out = out.union(found.select(f"{row}.*"))
    return out


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; null and wordless texts have fingerprint zero, equal fingerprints one component."""
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

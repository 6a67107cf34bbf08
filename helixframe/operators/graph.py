"""Connected components by star contraction, and clusters that are built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discarded, stored
from . import intervals as I


def _least_joined(many: DataFrame, one: DataFrame) -> DataFrame:
    """Join on v over another spelling of the key: a hub's rows are then an exchange of their own, which adaptive execution can split."""
    return many.withColumn("__k", F.bitwise_not("v")).join(one.withColumn("__k", F.bitwise_not("v")).drop("v"), "__k").drop("__k")


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes on edges between long ids; root is the least node of the component.

    Each round ties every node's larger neighbours, then its smaller ones, to its least neighbour, and is written to the shared folder. Edges never grow in number,
    and rounds grow with the logarithm of the component's size.
    """
    state = stored(edges.select(F.greatest(a, b).cast("long").alias("v"), F.least(a, b).cast("long").alias("u")).filter("u != v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = state.union(state.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        large = _least_joined(both, least).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u != v").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        tied = _least_joined(large, small).select(F.col("u").alias("v"), F.col("m").alias("u"))
        state, old = stored(tied.union(small.select("v", F.col("m").alias("u"))).filter("u != v").distinct(), "edges"), state
        discarded(old)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def clustered(rows: DataFrame, by: list[str], position: str, owner: str, gap: int) -> DataFrame:
    """(owner, cluster): owners whose rows lie within ``gap`` of one another on the same key are in one cluster, named by its least owner.

    Rows of one island tie all their owners to the island's least one, so edges are as many as rows.
    """
    marked = I.islands(rows, by, position, gap)
    least = marked.groupBy(*by, "island").agg(F.min(owner).alias("__least"))
    edges = marked.join(least, [*by, "island"]).select(F.col(owner).alias("a"), F.col("__least").alias("b"))
    found = components(edges, "a", "b")
    return rows.select(F.col(owner).cast("long").alias(owner)).distinct().join(found, F.col(owner) == F.col("node"), "left").select(owner, F.coalesce("root", owner).alias("cluster"))


def patients(samples: DataFrame, pairs: DataFrame, sample: str, a: str, b: str) -> DataFrame:
    """(sample, patient): samples that match, directly or over others, are one patient, named by the least sample."""
    found = components(pairs, a, b)
    return samples.select(F.col(sample).cast("long").alias(sample)).join(found, F.col(sample) == F.col("node"), "left").select(sample, F.coalesce("root", sample).alias("patient"))


def bands(rows: DataFrame, by: list[str], starts: Column, ends: Column, width: int, id_col: str) -> DataFrame:
    """(id_col, cluster): rows of one key whose both positions lie in neighbouring cells of ``width`` belong together.

    Cells of the plane are tied to their neighbours that have rows, so edges follow occupied cells and never pairs of rows.
    """
    cell = rows.select(id_col, *by, F.floor(starts / width).cast("long").alias("x"), F.floor(ends / width).cast("long").alias("y"))
    cells = cell.groupBy(*by, "x", "y").agg(F.min(id_col).alias("c"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (1, 1), (1, -1))])
    near = cells.select(*by, F.col("c").alias("a"), "x", "y", F.explode(steps).alias("s")).select(*by, "a", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"))
    found = components(near.join(cells.withColumnRenamed("c", "b"), [*by, "x", "y"]), "a", "b")
    named = cells.join(found, F.col("c") == F.col("node"), "left").select(*by, "x", "y", F.coalesce("root", "c").alias("cluster"))
    return cell.join(named, [*by, "x", "y"]).select(id_col, "cluster")

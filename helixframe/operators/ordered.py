"""Sums of doubles in a given order.

A sum of doubles depends on the order of its terms, and a comparison of it with a threshold may turn on its last digit. Partial sums of tasks meet in any order; these are added up row by row, as SQL on one thread does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregated(rows: DataFrame, keys: list[str], order: list[str], **aggregates: Column) -> DataFrame:
    """(keys, aggregates): as ``groupBy(keys).agg(...)``, with the rows of a key taken in ``order``, which must leave no ties.

    They are running aggregates of a window, so a key's rows are streamed by its task and not held.
    """
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.select(*keys, F.struct(*order).alias("__at"), *[a.over(so_far).alias(n) for n, a in aggregates.items()])
    last = running.groupBy(*keys).agg(F.max_by(F.struct(*aggregates), "__at").alias("__x"))
    return last.select(*keys, "__x.*")

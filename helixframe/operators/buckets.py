"""Ordered scans of a key's rows, dealt over tasks by buckets of positions.

A window partitioned by key alone is one task for each key. Here only rows of one bucket are sorted together; what a scan needs from the buckets before or behind it
is aggregated by bucket first and carried over them by a window that has one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def dealt(rows: DataFrame, position: str | Column, width: int) -> DataFrame:
    """The rows with their bucket; a null position has a bucket of its own, before all others."""
    at = F.col(position) if isinstance(position, str) else position
    return rows.withColumn(BUCKET, F.floor(at / width).cast("long"))


def within(by: list[str]) -> Window:
    return Window.partitionBy(*by, BUCKET)


def carried(rows: DataFrame, by: list[str], values: dict[str, tuple[Column, str]], behind: bool = False) -> DataFrame:
    """The rows with a column for each of values: (aggregate of a bucket, ``sum``, ``max`` or ``last`` of it over all buckets before; or behind).

    ``last`` is that of the nearest bucket with a value. Null where there is none.
    """
    per = rows.groupBy(*by, BUCKET).agg(*[a.alias(n) for n, (a, _) in values.items()])
    order = Window.partitionBy(*by).orderBy(F.desc(BUCKET) if behind else F.asc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    how = {"sum": lambda c: F.sum(c).over(order), "max": lambda c: F.max(c).over(order), "last": lambda c: F.last(c, ignorenulls=True).over(order)}
    steps = per.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate([*by, BUCKET])], *[how[h](n).alias(n) for n, (_, h) in values.items()])
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*by, BUCKET])]
    out = rows.join(steps, same, "left")
    return out.select(*rows.columns, *values)

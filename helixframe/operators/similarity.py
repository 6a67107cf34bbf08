"""Cosine similarities of vectors with queries.

Blocks of vectors meet blocks of queries, and a pair of blocks is one product of matrices. A product of matrices adds in an order of its own, so what it leaves too near to the middle of two rounded values is added up again from the first place to the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Vectors and queries of a block: a pair of blocks holds some megabytes.
VECTORS, QUERIES = 256, 512


def _blocks(rows: DataFrame, ident: str, vector: str, size: int, names: list[str]) -> DataFrame:
    """(ids, values, present, width): vectors side by side, padded with zeros; ``present`` is null where no place is null or padded."""
    ids, values, present, width = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                some = batch.slice(lo, size)
                found = some.column(1)
                lengths = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = found.flatten()
                wide = int(lengths.max())
                there = np.arange(wide) < lengths[:, None]
                x = np.zeros(there.shape)
                x[there] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
                if flat.null_count:
                    there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
                mask = None if there.all() else there.tobytes()
                columns = [pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([mask], pa.binary()), pa.array([wide], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select(F.col(ident).cast("long"), vector).mapInArrow(run, f"{ids} array<long>, {values} binary, {present} binary, {width} int")


def _in_order(terms: Iterator[np.ndarray], like: np.ndarray) -> np.ndarray:
    total = np.zeros(like.shape)
    for t in terms:
        total += t
    return total


def rounded_cosines(x: np.ndarray, has_x: np.ndarray | None, y: np.ndarray, has_y: np.ndarray | None, digits: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(cosine of each row of x with each of y, where it is null), the sums as of a loop over places; halves are rounded away from zero.

    Products are summed over places that both have, squares over a vector's own ones; without any there is none, and vectors of zeros give NaN.
    """
    w, one = min(x.shape[1], y.shape[1]), 10.0**digits
    squares = lambda v: _in_order((c * c for c in v.T), v[:, :1].sum(1))
    with np.errstate(all="ignore"):
        scale = np.sqrt(squares(x)[:, None] * squares(y)[None, :])
        whole = has_x is None and has_y is None and w > 0
        null = None
        if whole:
            value = x[:, :w] @ y[:, :w].T / scale
        else:
            hx, hy = (np.ones(v.shape, bool) if h is None else h for v, h in ((x, has_x), (y, has_y)))
            value = _in_order((np.where(hx[:, k, None] & hy[None, :, k], x[:, k, None] * y[None, :, k], 0.0) for k in range(w)), scale) / scale
            null = hx[:, :w].astype(float) @ hy[:, :w].T.astype(float) == 0
        t = value * one
        out = np.rint(t) / one
        # The error of a sum is at most its terms times the last digit's half; a margin of some times that is taken.
        i, j = np.nonzero(~(np.abs(t - np.floor(t) - 0.5) > 4 * one * (w + 8) * np.finfo(float).eps))
        if len(i):
            again = _in_order((x[i, k] * y[j, k] for k in range(w)), i) / scale[i, j] if whole else value[i, j]
            t = again * one
            cut = np.trunc(t)
            nearest = (cut + np.where(np.abs(t - cut) >= 0.5, np.sign(t), 0.0)) / one
            out[i, j] = np.where(np.isfinite(nearest), nearest, again)
    return out + 0.0, null


def cosines(rows: DataFrame, queries: DataFrame, ident: str, query: str, vector: str, digits: int) -> DataFrame:
    """(query, ident, similarity): of each row of ``queries`` with each of ``rows``, rounded; both have whole numbers as ids and arrays of numbers.

    The pairs are the result and grow with the product of both; memory does not, as a task holds pairs of blocks.
    """
    spark = rows.sparkSession
    # Stored, so that the planner knows the size of the queries: small ones are broadcast, others read by each task.
    asked = stored(_blocks(queries, query, vector, QUERIES, ["q", "x", "has_x", "m"]), "queries")
    dealt = _blocks(rows, ident, vector, VECTORS, ["v", "y", "has_y", "n"]).repartition(4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda data, width, n, kind: None if data is None else np.frombuffer(data, kind).reshape(n, width)
        for batch in batches:
            for k in range(batch.num_rows):
                q, x, hx, m, v, y, hy, n = (batch.column(c)[k] for c in ("q", "x", "has_x", "m", "v", "y", "has_y", "n"))
                a, b = q.values, v.values
                sides = [(of(d.as_buffer(), w.as_py(), len(i), float), of(h.as_buffer(), w.as_py(), len(i), bool)) for d, h, w, i in ((x, hx, m, a), (y, hy, n, b))]
                value, null = rounded_cosines(*sides[0], *sides[1], digits)
                left = a.take(pa.array(np.repeat(np.arange(len(a)), len(b))))
                right = b.take(pa.array(np.tile(np.arange(len(b)), len(a))))
                yield pa.RecordBatch.from_arrays([left, right, pa.array(value.ravel(), mask=None if null is None else null.ravel())], [query, ident, "similarity"])

    return dealt.crossJoin(asked).mapInArrow(run, f"`{query}` long, `{ident}` long, similarity double")

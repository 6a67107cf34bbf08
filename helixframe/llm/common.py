"""What the operators share: the library's tables and shared folder, bounded Arrow batches, and Arrow columns as numpy bytes.

Texts reach numpy as the UTF-8 buffer of an Arrow column, in blocks of whole rows of at most
``BLOCK_BYTES`` (one longer row is a block of its own), so memory follows the block and never
the partition.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..shipping import ship
from ..storage import discarded, scratch, scratch_path, stored, table

__all__ = ["blocks", "discarded", "fresh", "in_batches", "opened", "scratch", "scratch_path", "stored", "table", "tokenizer_path", "utf8"]

BLOCK_BYTES = 512 << 10
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """``df``, after limiting the session's Arrow batches to ``rows`` rows and about ``size`` bytes if it allows more: whole texts are long, and a batch is held by the JVM and by Python.

    One longer row is a batch of its own. The package is shipped too, as what follows runs in Python workers.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        if not 0 < int(conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB")) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
        taken.add(name.lower())
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins, with the end as last entry; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their bytes, and where each begins among those."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file, the same on driver and executors."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def opened(path: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)

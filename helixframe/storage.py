"""Reading the driver's tables, and cutting lineage through the shared folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shipping import ship

#: The open scopes of ``scratch``, innermost last: what each has to delete. A thread has its own.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table with the place of each row: ``__file`` and ``__row`` within it."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, what: str, outlives: bool = False) -> str:
    """A new path in the shared folder, which the innermost ``scratch`` scope deletes at its end, or, if it outlives that, the next outer one; without one it stays."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if len(open_scopes := _scopes.get()) > outlives:
        open_scopes[-1 - outlives].append(path)
    return path


def stored(df: DataFrame, what: str, outlives: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again."""
    path = scratch_path(df.sparkSession, what, outlives)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discarded(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    if path := getattr(df, "stored_at", None):
        removed(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators wrote into the shared folder within it. Results must be written (or read) inside: they are lazy.

    ``with scratch(spark): near_duplicates(docs).write.parquet(out)`` leaves only ``out``. Scopes nest; each has its own paths.
    """
    own: list[str] = []
    before = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(before)
        for path in own:
            removed(spark, path)

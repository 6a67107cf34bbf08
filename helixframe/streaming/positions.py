"""State that is released by the progress of a scan along a contig, not by time.

Reads come roughly in the order of their positions. Each contig buffers what it has summed by position; what lies further behind the furthest read than ``reach`` can't change any more and is released in order. So the
buffer holds the positions of one reach at most, however long the scan is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps single entries of a map; Spark's default one can't.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ByPosition(StatefulProcessor):
    """Sums of reads by position, as a map of the buffered positions, and how far the scan and its releases have come."""

    def __init__(self, key: str, reach: int):
        self.key, self.reach = key, reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getMapState("buffer", "position long", "n long, total double")
        self.progress = handle.getValueState("progress", "furthest long, released long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        furthest, released = map(int, self.progress.get()) if self.progress.exists() else (-1, -1)
        out, ended = [], False
        for batch in rows:
            ended |= bool(batch["position"].isna().any())
            known = batch.dropna(subset=["position"])
            for p, n, total in known.groupby("position")["value"].agg(["size", "sum"]).reset_index().itertuples(index=False):
                p = int(p)
                if p <= released:
                    out.append((p, int(n), float(total), True))
                    continue
                if self.buffer.containsKey((p,)):
                    old = self.buffer.getValue((p,))
                    n, total = n + old[0], total + old[1]
                self.buffer.updateValue((p,), (int(n), float(total)))
                furthest = max(furthest, p)
        limit = furthest if ended else furthest - self.reach - 1
        if limit > released:
            done = sorted(k[0] for k in self.buffer.keys() if k[0] <= limit)
            for p in done:
                n, total = self.buffer.getValue((p,))
                out.append((p, int(n), float(total), False))
                self.buffer.removeKey((p,))
            released = limit
        self.progress.update((furthest, released))
        yield pd.DataFrame([(*key, *r) for r in out], columns=[self.key, "position", "n", "total", "late"])

    def close(self) -> None:
        pass


def released(reads: DataFrame, key: str, position: str, value: str, reach: int) -> DataFrame:
    """(key, position, n, total, late): reads of a stream summed by position, released once the furthest read of their key is more than ``reach`` beyond, in the order of positions within a key.

    A null position tells that a key's scan has ended, and releases all. A read at or before a position that was released already comes out at once, as late, with what its batch has for that position. Null values count as reads and add
    nothing. State is a row for each position of a reach.
    """
    kind = reads.schema[key].dataType.simpleString()
    rows = reads.select(key, F.col(position).cast("long").alias("position"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
    return rows.groupBy(key).transformWithStateInPandas(ByPosition(key, reach), f"{key} {kind}, position long, n long, total double, late boolean", "Append", "None")


def with_map_state(spark: SparkSession) -> SparkSession:
    """A session of its own, with the state store that ``released`` needs; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set(*STORE)
    return own

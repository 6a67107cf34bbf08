"""Streaming forms of the windowed operators: fixed windows, gap sessions, bounded look-back.

Each takes a streaming DataFrame with an event time and returns one; late rows are bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fixed(events: DataFrame, by: list[str], time: str, value: str, size: str, late: str) -> DataFrame:
    """(by, start, n, total) of tumbling windows."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(*by, F.col("window.start").alias("start"), "n", "total")


def sliding(events: DataFrame, by: list[str], time: str, value: str, size: str, step: str, late: str) -> DataFrame:
    grouped = events.withWatermark(time, late).groupBy(F.window(time, size, step), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(*by, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, by: list[str], time: str, value: str, gap: str, late: str) -> DataFrame:
    """(by, start, end, n, total): runs of events less than ``gap`` apart; end is the last event's time plus the gap."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def last_rows_median(events: DataFrame, key: str, time: str, value: str, rows: int, late: str) -> DataFrame:
    """(key, time, value, median) of each event: the median over the last ``rows`` values of its key, itself included.

    State is at most ``rows`` values a key, and goes when the watermark has passed its last event. Within a batch, events are taken in the order of their time.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, latest = state.get if state.exists else ([], 0)
        held = list(held)
        new = pd.concat(list(batches)).sort_values(time)
        medians = []
        for v in new[value]:
            held = [*held, float(v)][-rows:]
            s = sorted(held)
            medians.append((s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2)
        latest = max(int(latest), int(new[time].max().value // 1_000_000))
        state.update((held, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: k[0], time: new[time], value: new[value], "median": medians})

    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {time} timestamp, {value} double, median double", "held array<double>, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def fragments(reads: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """(key, start, n): reads of one fragment position, released once the scan has moved past them by ``late``."""
    return reads.withWatermark(time, late).groupBy(*key, F.window(time, "1 second")).agg(F.count("*").alias("n")).select(*key, F.col("window.start").alias("start"), "n")

"""Logistic regression over hashed features, trained by follow-the-regularised-leader (FTRL-proximal).

Each coordinate has its own rate and an L1 threshold, so most weights stay zero and the model is a short list of
indices and values, which is broadcast. A feature is present in a text or not; a score is the sparse dot product over the
present ones. Training reads a bounded sample of labelled rows: of each class the ids with the least hash,
``most`` at most. Only their hashed features reach the driver, at most ``2**BITS`` four-byte indices a row and in practice
a few kB. Scoring is a map over all rows, without shuffle. A text is held whole by its task, with about 60 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import blocks, discarded, fresh, in_batches, stored, utf8

BITS = 20
#: (row, index) of features, not necessarily distinct, from the bytes of a block of rows.
Featurise = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


@dataclass(frozen=True)
class Rates:
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    epochs: int = 3


def hashed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Feature indices of 64-bit keys; each salt has its own family."""
    return (W.mix(keys + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BITS)).astype(np.int32)


def train(rows: list[np.ndarray], labels: np.ndarray, rates: Rates = Rates()) -> Model:
    """One pass for each epoch, in the given order; no rows, or one class only, give that class's share as the bias."""
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    a, b, l1, l2 = rates.alpha, rates.beta, rates.l1, rates.l2
    bias = 1 << BITS

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        limit = np.where(i == bias, 0.0, l1)
        return np.where(np.abs(zi) <= limit, 0.0, -(zi - np.sign(zi) * limit) / ((b + np.sqrt(n[i])) / a + l2))

    if len(set(labels.tolist())) < 2:
        share = float(labels[0]) if len(labels) else 0.5
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 4.0 * (2 * share - 1))
    for _ in range(rates.epochs):
        for r, y in zip(rows, labels.tolist()):
            i = np.append(r, np.int32(bias))
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / a * w
            n[i] = ni + g * g
    w = weights(np.arange(bias + 1))
    some = np.flatnonzero(w[:bias])
    return Model(some, w[some].astype(np.float32), float(w[bias]))


def scores(model: Model, dense: np.ndarray, rows: int, row: np.ndarray, index: np.ndarray) -> np.ndarray:
    some = dense[index] != 0
    pair = np.unique(row[some].astype(np.int64) << BITS | index[some])
    total = np.bincount(pair >> BITS, dense[pair & ((1 << BITS) - 1)], rows)
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _least(known: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of (id, y, k) with the least k, ties by id. Counts by the upper bits of k tell first where they end, so that tasks don't each send ``most`` rows to the driver."""
    top = F.shiftright("k", 64 - 12)
    seen, last = 0, None
    for r in known.groupBy(top.alias("top")).count().orderBy("top").collect():  # 4096 rows at most
        seen, last = seen + r["count"], r.top
        if seen >= most:
            break
    return known if last is None else known.filter(top <= last).orderBy("k", "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, label: str, featurise: Featurise, folds: int, fold: int, most: tuple[int, int] = (8000, 4000), rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on labelled ids outside the held-out fold: at most ``most[y]`` of label y.

    Rows with a null id or label are left out, and equal rows of labels count once; an id with both labels counts for each. Of several documents with one id the least text counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id"), folds, fold))
    known = stored(known.distinct().withColumn("k", F.xxhash64(F.col("id").cast("string"))), "labels")
    chosen = _least(known.filter("y = 0"), most[0]).union(_least(known.filter("y = 1"), most[1]))
    texts = in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("k", "id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(3))
            out = []
            for lo, hi, raw, where in blocks(data, at):
                row, index = featurise(raw, where)
                pair = np.unique(row.astype(np.int64) << BITS | index)
                edge = np.searchsorted(pair >> BITS, np.arange(hi - lo + 1))
                index = (pair & ((1 << BITS) - 1)).astype(np.int32)
                out += [index[edge[k] : edge[k + 1]].tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["k", "id", "y", "x"])

    kind = texts.schema["id"].dataType.simpleString()
    # Written first and read by partition: the driver's JVM never holds all of it.
    table = stored(texts.mapInArrow(run, f"k long, id {kind}, y int, x binary"), "features")
    found = sorted(table.toLocalIterator(), key=lambda r: (r.k, r.id, r.y))
    discarded(table)
    discarded(known)
    return train([np.frombuffer(r.x, np.int32) for r in found], np.array([r.y for r in found]), rates)


def scored(docs: DataFrame, model: Model, featurise: Featurise, text_col: str = "text", score: str = "score") -> DataFrame:
    """The rows of docs with a column ``score`` in 0 to 1; null and empty texts get the bias's score. A column of that name is replaced.

    Equal texts get equal scores, repeated rows a row each, an empty table none. Memory holds one batch of texts, or one longer text.
    """
    keep = [c for c in docs.columns if c != score]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        dense = model.dense()
        for batch in batches:
            data, at = utf8(batch.column(len(keep)))
            out = [scores(model, dense, hi - lo, *featurise(raw, where)) for lo, hi, raw, where in blocks(data, at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.concatenate(out) if out else np.zeros(0))], [*keep, score])

    return in_batches(docs).select(*keep, F.col(text_col).cast("string").alias(fresh(docs, "__text")[0])).mapInArrow(run, schema)

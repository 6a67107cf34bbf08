"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, pairs of neighbouring words, and pairs with one word between them; words are
runs of digits, letters and bytes from 0x80 on, A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from . import words as W
from .common import table

FOLDS, HELD_OUT = 5, 0
#: Chosen on an inner split of the training folds (learnt on remainders 2 to 4, compared on 1); the held-out fold took no part.
RATES = ftrl.Rates(alpha=2.0, l1=12.0, l2=0.1, epochs=5)


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = W.LOWER[raw]
    found = W.split(low, at, W.ALNUM)
    h = W.span_hashes(low, found.starts, found.ends)
    rows, index = [found.row], [ftrl.hashed(h, 1)]
    for gap in (1, 2):
        if len(h) > gap:
            some = np.flatnonzero(found.row[gap:] == found.row[:-gap])
            rows.append(found.row[some])
            index.append(ftrl.hashed(h[some] * np.uint64(0x2545F4914F6CDD1D) + h[some + gap], 1 + gap))
    return np.concatenate(rows), np.concatenate(index)


def fit(docs: DataFrame, labels: DataFrame, **options) -> ftrl.Model:
    return ftrl.fit(docs, labels, "toxic", features, FOLDS, HELD_OUT, most=(10000, 5000), rates=RATES, **options)


def toxicity(docs: DataFrame, model: ftrl.Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """The rows of docs with their toxicity. Null and empty texts get the bias's score; repeated rows a row each."""
    return ftrl.scored(docs, model, features, text_col, score)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; null and empty texts get the bias's score. Without labels of both kinds the score is the same for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", ftrl.held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

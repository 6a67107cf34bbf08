"""Quality: hashed word n-gram logistic regression trained by follow-the-regularised-leader, scored as sparse dot products.

Words are runs without white space. Their n-grams are hashed in two spellings: the word itself, A-Z
lower-cased (one and two words), and its shape (one to three words), which tells capitals, digits and kinds of punctuation, and
whether the word equals the one before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from . import words as W
from .common import table

FOLDS, HELD_OUT = 3, 1
RATES = ftrl.Rates(alpha=0.2, l1=1.0, epochs=3)

#: The kind of each byte, a bit each: upper, lower (or beyond ASCII), digit, sentence marks, !, symbols, |, others.
_KIND = np.full(256, 128, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 4
for _bit, _chars in ((8, b".,;:?"), (16, b"!"), (32, b"#*$%&<>"), (64, b"|")):
    _KIND[list(_chars)] = _bit


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = W.LOWER[raw]
    found = W.split(low, at, W.SOLID)
    if not len(found.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = W.span_hashes(low, found.starts, found.ends)
    kinds = np.bitwise_or.reduceat(np.where(W.SOLID[raw], _KIND[raw], np.uint8(0)), found.starts).astype(np.uint64)
    same = np.zeros(len(h), np.uint64)
    same[1:] = (h[1:] == h[:-1]) & (found.row[1:] == found.row[:-1])
    shape = W.mix(kinds * np.uint64(2) + same + np.uint64(1))
    rows, index = [], []
    for n, spelling, salt in ((1, h, 11), (2, h, 12), (1, shape, 13), (2, shape, 14), (3, shape, 15)):
        where, gram = W.grams(spelling, n, found.row)
        rows.append(found.row[where])
        index.append(ftrl.hashed(gram, salt))
    return np.concatenate(rows), np.concatenate(index)


def fit(docs: DataFrame, labels: DataFrame, **options) -> ftrl.Model:
    return ftrl.fit(docs, labels, "quality", features, FOLDS, HELD_OUT, most=(6000, 6000), rates=RATES, **options)


def quality(docs: DataFrame, model: ftrl.Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """The rows of docs with their quality. Null and empty texts get the bias's score; repeated rows a row each."""
    return ftrl.scored(docs, model, features, text_col, score)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; null and empty texts get the bias's score. Without labels of both kinds the score is the same for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", ftrl.held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

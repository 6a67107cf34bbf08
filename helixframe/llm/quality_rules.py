"""Repetition rules over whole texts: characters inside duplicated n-grams and lines.

Word hashes are rolled into hashes of windows of several lengths in numpy. A window that a text has twice or more covers its words,
and the covered characters are set against all characters in words. All that is counted lies within
one text, so rows never meet: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import blocks, fresh, in_batches, table, utf8

#: Largest share of characters in words that may lie inside duplicated windows, by words in a window.
GRAM_SHARES = {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30}
#: Largest shares of lines (one repeated line in a short text is no fault), and of characters in words, that may repeat an earlier line.
LINE_SHARE, LINE_CHARS = 0.50, 0.30
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _covered(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Whether each word lies in a window of n words that its row has twice or more."""
    where, gram = W.grams(hashes, n, row)
    inside = np.zeros(len(hashes) + 1, np.int64)
    if len(where):
        key = W.mix(gram ^ (row[where].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        inside[where[twice]] += 1
        np.add.at(inside, where[twice] + n, -1)
    return np.cumsum(inside[:-1]) > 0


def measure(raw: np.ndarray, at: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """COUNTS of each row, the characters covered by windows of each length (gram_<n>), n_lines and dup_line_chars."""
    found = W.split(raw, at, W.SOLID)
    n = found.counts()
    out = {"n_words": n}
    begins = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(begins & W.SOLID[raw], dtype=np.int64)])
    out["word_chars"] = before[at[1:]] - before[at[:-1]]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = _per_row(symbol[raw], at)

    # Lines: from each row's start or a newline to the next newline or the row's end.
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([at[:-1], breaks + 1])
    ends = np.concatenate([breaks, at[1:]])
    row = np.concatenate([np.arange(len(n)), np.searchsorted(at, breaks, "right") - 1])
    end_row = np.concatenate([np.searchsorted(at, breaks, "right") - 1, np.arange(len(n))])
    a, b = np.lexsort((starts, row)), np.lexsort((ends, end_row))
    starts, ends, row = starts[a], ends[b], row[a]
    words_in = np.searchsorted(found.starts, ends, "left") > np.searchsorted(found.starts, starts, "left")
    starts, ends, row = starts[words_in], ends[words_in], row[words_in]
    key = W.mix(W.span_hashes(raw, starts, ends) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    out["n_lines"] = np.bincount(row, minlength=len(n))
    out["n_dup_lines"] = np.bincount(row[again], minlength=len(n))
    out["dup_line_chars"] = np.bincount(row[again], (before[ends] - before[starts])[again], len(n)).astype(np.int64)

    hashes = W.span_hashes(raw, found.starts, found.ends)
    chars = before[found.ends] - before[found.starts]
    for k in sorted({8, *lengths}):
        inside = _covered(hashes, found.row, k)
        if k == 8:
            out["n_repeat_words"] = _per_row(inside, found.first)
        out[f"gram_{k}"] = _per_row(np.where(inside, chars, 0), found.first)
    return out


def repetition(docs: DataFrame, text_col: str = "text", shares: dict[int, float] | None = None, line_share: float = LINE_SHARE, line_chars: float = LINE_CHARS) -> DataFrame:
    """The rows of docs with COUNTS, base_failed, kept, and dup_gram_share (the largest share over the lengths) and dup_line_share.

    base_failed: under 20 words, or over 30 % of the words in repeated windows of 8. kept: neither that, nor a share over its limit.
    Words are runs without white space (U+0020, U+0009 to U+000D); a null or empty text has none and fails. Windows and lines are compared within
    one text by 64-bit hashes; of equal lines the first is no duplicate. Repeated rows each get a row with equal results, an empty table gives none; columns of docs
    that have the result's names are replaced. Memory holds one block of texts, or one longer text with about 100 bytes for each of its words.
    """
    limits = GRAM_SHARES if shares is None else shares
    results = [*COUNTS, "base_failed", "kept", "dup_gram_share", "dup_line_share"]
    keep = [c for c in docs.columns if c not in results]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"{c} long" for c in COUNTS] + ["base_failed boolean, kept boolean, dup_gram_share double, dup_line_share double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(len(keep)))
            parts = [measure(raw, where, tuple(limits)) for _, _, raw, where in blocks(data, at)]
            m = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
            if not m:
                continue
            chars = np.maximum(m["word_chars"], 1)
            failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            over = np.zeros(len(failed), bool)
            share = np.zeros(len(failed))
            for k, most in limits.items():
                part = m[f"gram_{k}"] / chars
                over |= part > most
                share = np.maximum(share, part)
            lines = m["n_dup_lines"] / np.maximum(m["n_lines"], 1)
            over |= (lines > line_share) | (m["dup_line_chars"] / chars > line_chars)
            columns = [*batch.columns[: len(keep)], *[pa.array(m[c], pa.int64()) for c in COUNTS], pa.array(failed), pa.array(~failed & ~over), pa.array(share), pa.array(lines)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *results])

    return in_batches(docs).select(*keep, F.col(text_col).cast("string").alias(fresh(docs, "__text")[0])).mapInArrow(run, schema)


def op7_repetition(spark, sf_dir: str) -> DataFrame:
    """The rules' counts and verdict of every document; null and wordless texts have no words and fail."""
    return repetition(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

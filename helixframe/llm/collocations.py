"""Phrases whose words stand together more often than chance has it, from word-id suffix arrays.

Each task lays its texts end to end as word ids, a shard of ``SHARD`` bytes at a time, and sorts the suffixes by prefix doubling. Neighbours
in that order that share k words or more form intervals; an interval's size is how often its k words stand in the shard. Counts are added up over
shards by phrase.

Phrases are counted by level, as no phrase is more frequent than a part of it: words; pairs of frequent words, by their hashes alone, as nearly all of them are rare; then phrases of two words and more
whose pairs are all frequent, by their bytes. A level
knows the one before by a bitmap of 2**``BITS`` hashed phrases, whose size is fixed: a phrase that is there by chance alone is counted for nothing, none is missed.

All that follows (cuts into two parts, parts within longer candidates, ranks) is joins over the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import blocks, in_batches, stored, table, utf8

LEAST = 100
LONGEST = 5
TOP = 2000
SHARE = 100
SHARD = 8 << 20
BITS = 26
#: [.,;:!?\x0A-\x0D] ends a piece; these, space and tab stand between words.
BREAK = np.array([b in b".,;:!?" or 10 <= b <= 13 for b in range(256)])
WORD = np.array([not BREAK[b] and b not in b" \t" for b in range(256)])
UNKNOWN = "und"


@dataclass
class Sequence:
    """Words of many texts: their bytes with a space behind each, where each begins and ends there, hashes (with the language), whether the next word follows in the same piece, and the row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    joined: np.ndarray
    row: np.ndarray


def sequence(text: pa.Array, lang: pa.Array) -> Sequence:
    data, at = utf8(text)
    tongue, where = utf8(lang)
    salt = W.mix(W.span_hashes(np.append(tongue, np.uint8(0)), where[:-1], where[1:]))
    out: list[list[np.ndarray]] = []
    size = 0
    for lo, hi, raw, begins in blocks(data, at):
        low = W.LOWER[raw]
        found = W.split(low, begins, WORD)
        if not len(found.starts):
            continue
        n = found.ends - found.starts
        # A break between the end of a word and the next one's start.
        cut = np.concatenate([[0], np.cumsum(BREAK[low])])
        joined = np.zeros(len(n), bool)
        joined[:-1] = (cut[found.ends[:-1]] == cut[found.starts[1:]]) & (found.row[:-1] == found.row[1:])
        ends = np.cumsum(n + 1) - 1
        own = np.full(int(ends[-1]) + 1, 32, np.uint8)
        own[np.arange(len(own) - len(n)) + np.repeat(np.arange(len(n)), n)] = low[_inside(found, len(low))]
        out.append([own, ends - n + size, ends + size, W.mix(W.span_hashes(low, found.starts, found.ends) + salt[found.row + lo]), joined, found.row + lo])
        size += len(own)
    none = [np.zeros(0, t) for t in (np.uint8, np.int64, np.int64, np.uint64, bool, np.int64)]
    return Sequence(*[np.concatenate(x) for x in zip(*out)]) if out else Sequence(*none)


def _inside(found: W.Words, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int8)
    step[found.starts] += 1
    step[found.ends] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).astype(bool)


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions ordered by the up to ``depth`` words that follow in their segment (of which each has ``left``), by prefix doubling; and how many words each shares with the one before it."""
    n = len(ids)
    rank, step = ids + 1, 1
    ranks = [rank]  # of the first one, two, four ... words
    order = np.argsort(rank, kind="stable")
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = np.where(left[: n - step] > step, rank[step:], 0) if n > step else 0
        both = rank * np.int64(n + 2) + after
        order = np.argsort(both, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = both[order[1:]] != both[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
        ranks.append(rank)
    # Common words: the largest powers of two whose ranks agree, one after another.
    shared = np.zeros(n, np.int64)
    a, b = order[1:], order[:-1]
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + shared[1:], b + shared[1:]
        fits = (left[a] - shared[1:] >= 1 << k) & (left[b] - shared[1:] >= 1 << k)
        same = fits & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        shared[1:] += np.where(same, 1 << k, 0)
    return order, shared


def intervals(order: np.ndarray, shared: np.ndarray, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A position of each phrase of k words, and how often it stands: intervals of suffixes that share k words."""
    head = np.flatnonzero((left[order] >= k) & (shared < k))
    # Suffixes with fewer words stand before those that go on, so an interval ends where the next begins or such a one stands.
    stop = np.flatnonzero(shared < k)
    return order[head], np.append(stop[1:], len(order))[np.searchsorted(stop, head)] - head


def lefts(joined: np.ndarray) -> np.ndarray:
    """Of each word how many words there are to the end of its segment, itself included; ``joined``: the next is in the same."""
    ends = np.flatnonzero(~joined)
    return ends[np.searchsorted(ends, np.arange(len(joined)))] - np.arange(len(joined)) + 1 if len(joined) else np.zeros(0, np.int64)


def gram_counts(own: Sequence, joined: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first words, counts) of the phrases of ``least`` to ``most`` words within segments."""
    left = lefts(joined)
    # Segments too short are left out.
    size = left + np.arange(len(left)) - np.maximum.accumulate(np.where(np.append([True], ~joined[:-1])[: len(left)], np.arange(len(left)), 0)) if len(left) else left
    place = np.flatnonzero(size >= least)
    if not len(place):
        return
    left = left[place]
    _, ids = np.unique(own.hashes[place], return_inverse=True)
    order, shared = suffix_array(ids.astype(np.int64), left, most)
    for k in range(least, most + 1):
        at, n = intervals(order, shared, left, k)
        yield k, place[at], n


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """Of each word but the last, with its next one."""
    return W.mix(hashes[:-1] * np.uint64(0x2545F4914F6CDD1D) + hashes[1:])


def ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each start:end as an Arrow string column."""
    n = ends - starts
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = data[np.repeat(starts - offsets[:-1], n) + np.arange(int(offsets[-1]))]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def _known(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


def _mapped(docs: DataFrame, of_shard, schema: str, shard: int) -> DataFrame:
    """What ``of_shard`` (sequence, languages of its rows) yields for each task's texts, about ``shard`` bytes at a time; docs: (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, size = [], [], 0
        for batch in batches:
            texts.append(batch["text"])
            langs.append(batch["lang"])
            size += batch["text"].nbytes
            if size >= shard:
                lang = pa.concat_arrays(langs)
                yield from of_shard(sequence(pa.concat_arrays(texts), lang), lang)
                texts, langs, size = [], [], 0
        if texts:
            lang = pa.concat_arrays(langs)
            yield from of_shard(sequence(pa.concat_arrays(texts), lang), lang)

    return docs.mapInArrow(run, schema)


def _phrases(own: Sequence, lang: pa.Array, joined: np.ndarray, least: int, most: int, step: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    for k, first, n in gram_counts(own, joined, least, most):
        for c in range(0, len(first), step):
            at = first[c : c + step]
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(own.row[at])), ranges(own.data, own.starts[at], own.ends[at + k - 1]), pa.array(n[c : c + step])], ["lang", "phrase", "n"])


def word_counts(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, n) of words, and with a null phrase how many words a language has."""

    def of(own: Sequence, lang: pa.Array) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([lang, pa.nulls(len(lang), pa.string()), pa.array(np.bincount(own.row, minlength=len(lang)))], ["lang", "phrase", "n"])
        yield from _phrases(own, lang, np.zeros(len(own.joined), bool), 1, 1)

    return _mapped(docs, of, "lang string, phrase string, n long", shard).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, words, shard: int = SHARD) -> DataFrame:
    """(key, n): how often pairs of words of the bitmap stand together, by the hash of language and words."""

    def of(own: Sequence, lang: pa.Array) -> Iterator[pa.RecordBatch]:
        often = _known(own.hashes, words.value)
        keys = pair_hashes(own.hashes).view(np.int64)
        for _, first, n in gram_counts(own, own.joined & often & np.append(often[1:], False), 2, 2):
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(n)], ["key", "n"])

    return _mapped(docs, of, "key long, n long", shard).groupBy("key").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, pairs, longest: int = LONGEST, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, n) of phrases of two words and more whose pairs are all in the bitmap."""

    def of(own: Sequence, lang: pa.Array) -> Iterator[pa.RecordBatch]:
        joined = own.joined.copy()
        if len(joined):
            joined[:-1] &= _known(pair_hashes(own.hashes), pairs.value)
        yield from _phrases(own, lang, joined, 2, longest)

    return _mapped(docs, of, "lang string, phrase string, n long", shard).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def word_hashes(words: DataFrame) -> DataFrame:
    """(key) of words (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sequence(batch["phrase"], batch["lang"]).hashes.view(np.int64))], ["key"])

    return in_batches(words).select("lang", "phrase").mapInArrow(run, "key long")


def bitmap_of(hashes: DataFrame):
    """A broadcast bitmap of 2**BITS bits in which hashes (key) are set; the driver gets a row for each 64 bits at most."""
    slot = F.shiftrightunsigned("key", 64 - BITS)
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(key, {64 - BITS}) & 63 AS INT))")
    lanes = hashes.groupBy(F.shiftrightunsigned(slot, 6).alias("lane")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[lanes["lane"].to_numpy()] = lanes["bits"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of the phrases of 1 to ``longest`` words that stand ``least`` times or more in a language; and (lang, total) of its words."""
    given = in_batches(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = stored(word_counts(given, shard).filter((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    totals = words.filter("phrase IS NULL").select("lang", F.col("n").alias("total"))
    words = words.filter("phrase IS NOT NULL")
    found = words.withColumn("words", F.lit(1))
    if longest > 1:
        pairs = bitmap_of(pair_counts(given, bitmap_of(word_hashes(words)), shard).filter(F.col("n") >= least))
        more = phrase_counts(given, pairs, longest, shard).filter(F.col("n") >= least)
        found = found.union(more.withColumn("words", F.size(F.split("phrase", " "))))
    return found.select("lang", "phrase", "words", "n"), totals


def _span(parts: str, a, n) -> F.Column:
    return F.array_join(F.slice(parts, a, n), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, share: int = SHARE, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases of 2 to ``longest`` words by score, then count, then bytes of the phrase.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at spaces and tabs. n: the language's words; a, l, r: how often the phrase, its first and its second part stand within pieces, at the
    cut with the lowest floor(1000 a n / (l r)), ties at the first. Phrases below ``least`` are no candidates; those inside a longer candidate that stands ``share`` per cent as often go.
    Null texts are empty, null languages ``und``; repeated rows count each; an empty table gives no rows; other columns are ignored, so names can't clash. A text is held whole by its task; results don't
    depend on ``shard``.
    """
    found, totals = frequent_phrases(docs, lang_col, text_col, least, longest, shard)
    found = stored(found, "phrases")
    several = found.filter("words > 1").withColumn("parts", F.split("phrase", " "))
    # Every contiguous part of two words or more of a longer candidate.
    begin_and_size = F.expr("flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), b -> struct(b AS b, s AS s))))")
    inner = several.filter("words > 2").select("lang", "n", "parts", F.explode(begin_and_size).alias("p"))
    around = inner.select("lang", _span("parts", F.col("p.b"), F.col("p.s")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = several.join(around, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * share))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _span("parts", F.lit(1), F.col("cut")).alias("left"), _span("parts", F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    both = cuts.join(found.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(found.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(totals, "lang")
    whole = "decimal(19,0)"
    score = F.expr(f"CAST(1000 * a AS {whole}) * CAST(total AS {whole}) div (CAST(l AS {whole}) * CAST(r AS {whole}))").cast("long")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r", "total")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", F.col("c.total").alias("n"), "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order))
    if top is not None:  # Spark keeps the first rows of each task before it deals them by language
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first 2000 phrases of two to five words that stand 100 times or more.

    Null texts are empty, null languages ``und``; without frequent phrases there are no rows.
    """
    return collocations(table(spark, sf_dir, "documents"))

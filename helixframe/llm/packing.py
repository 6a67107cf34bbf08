"""Best-fit packing of tokenised documents into sequences of fixed length.

Only the histogram of piece lengths reaches the driver (one count for each length). There, patterns of two and three lengths
that fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least
squares, and rounded within what is left of each length; the residual histogram is packed best-fit, longest first,
in runs of equal sequences. The plan has a row for each pattern, at most a few times the number of lengths plus ``PATTERNS``, and is broadcast.

A piece finds its place by its rank among the pieces of its length. Ranks come from counts by partition and
length, so no length is ever gathered in one task.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, stored, table, tokenizer_path

SEQUENCE = 2048
END = 0
PATTERNS = 40_000
ROUNDS = 200


class Encoder:
    """Token ids as little-endian 32-bit bytes, from a cache of words.

    Where the tokenizer splits texts by the byte-level pattern, no token spans a single space between two other characters from the
    left, nor a newline between two such, nor the place between letters and marks behind them, so a text may be cut
    there, and each part is encoded once. Runs of letters go to the tokenizer's model directly, in its byte alphabet.
    Other tokenizers encode whole texts. Strings of special tokens are ordinary text. The cache has two generations; the older is dropped when the newer is full.
    """

    MOST, LONG = 150_000, 48
    _twice = re.compile(r"\s\s")
    _cut = re.compile(r"(?<=\S) (?=\S)")
    _marked = re.compile(r"( ?[^\W\d_]+)([.,;:!?*%#$&|]+)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        told = json.loads(self.tokenizer.to_str())
        split = told["pre_tokenizer"] or {}
        self.cuts = told["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and told["model"]["type"] == "BPE"
        # The byte alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.alphabet = {b: 256 + k for k, b in enumerate(other)}
        self.space, self.tokens = chr(self.alphabet[32]), self.tokenizer.model.tokenize
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def letters(self, word: str) -> bytes:
        """Of a run of letters, with a space in front or not."""
        if word.isascii():
            word = self.space + word[1:] if word[0] == " " else word
        else:
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return struct.pack(f"<{len(ids := self.tokens(word))}I", *[t.id for t in ids])

    def parts(self, text: str) -> list[str]:
        if self._twice.search(text):
            first, *rest = self._cut.split(text)
            return [first, *[" " + x for x in rest]]
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def learn(self, parts: set[str]) -> None:
        """Put the ids of parts into the newer generation."""
        new, old = self.new, self.old
        rest = []
        for p in parts.difference(new):
            if (ids := old.get(p)) is not None:
                new[p] = ids
            elif (p[1:] if p[:1] == " " else p).isalpha():
                new[p] = self.letters(p)
            else:
                rest.append(p)
        whole = []
        for p in rest:
            if m := self._marked.fullmatch(p):
                ids = b""
                for x in m.groups():
                    got = new.get(x)
                    if got is None:
                        got = new[x] = old.get(x) or (self.letters(x) if (x[1:] if x[0] == " " else x).isalpha() else self.plain([x])[0])
                    ids += got
                new[p] = ids
            else:
                whole.append(p)
        new.update(zip(whole, self.plain(whole)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.plain(texts)
        cut = [self.parts(t) if "\0" not in t else [t] for t in texts]
        if len(self.new) > self.MOST:
            self.new, self.old = {}, self.new
        parts = {p for own in cut for p in own}
        self.learn(parts)
        out = [b"".join(map(self.new.__getitem__, own)) for own in cut]
        for p in parts:
            if len(p) > self.LONG:
                del self.new[p]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's own, so that the tasks that it runs one after another share the cache."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, part, nth[, ids]): each document's ids and the end id, longer ones cut.

    Of a longer document, the first piece takes what is over, and all others are full. nth counts the pieces of this length within the partition ``part``.
    Null texts are empty: one piece of the end id alone.
    """
    path = tokenizer or tokenizer_path()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64).tolist()
        for batch in batches:
            rows, lo = batch.num_rows, 0
            texts = batch.column(1)
            while lo < rows:
                hi, held, some = lo, 0, []
                while hi < rows and (hi == lo or held < 1 << 20):
                    some.append(texts[hi].as_py() or "")
                    held += len(some[-1])
                    hi += 1
                which, number, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for k, raw in enumerate(coder.encode(some), lo):
                    raw += last
                    n = len(raw) >> 2
                    a, number_of = 0, 0
                    while a < n:
                        b = min(n, a + ((n - a) % size or size))
                        own = raw[4 * a : 4 * b]
                        which.append(k)
                        number.append(number_of)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own))
                        nth.append(seen[b - a])
                        seen[b - a] += 1
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int32))
                        a, number_of = b, number_of + 1
                columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)], pa.array([part] * len(which), pa.int32()), pa.array(nth, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)
                lo = hi

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def patterns(counts: np.ndarray, size: int, most: int = PATTERNS) -> np.ndarray:
    """Two or three lengths that have pieces and fill a sequence, a row each (zero: no third).

    Of each longest length about as many, ``most`` in all: those whose rarest length is most common.
    """
    have = np.flatnonzero(counts)
    out = []
    a = have[2 * have >= size]
    a = a[a < size]
    b = size - a
    ok = counts[b] > 0
    out.append(np.stack([a[ok], b[ok], np.zeros(ok.sum(), np.int64)], 1))
    for x in have[have < size]:
        y = have[(have <= x) & (2 * have >= size - x) & (have < size - x)]
        z = size - x - y
        ok = (z > 0) & (z <= y) & (counts[z] > 0)
        out.append(np.stack([np.full(ok.sum(), x), y[ok], z[ok]], 1))
    found = np.concatenate(out)
    rare = np.where(found > 0, counts[found], counts.max(initial=0)).min(1)
    by = np.lexsort((-rare, found[:, 0]))
    found = found[by]
    begin = np.searchsorted(found[:, 0], found[:, 0])  # where the patterns of the same longest length begin
    return found[np.arange(len(found)) - begin < max(1, most // max(1, len(np.unique(found[:, 0]))))]


def fit(found: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, settled: float = 1e-4) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by multiplicative updates.

    They never raise the residual. The rounds end where no count changes by more than ``settled`` of the largest, or after ``rounds`` of them: what the fit leaves is packed
    best-fit, so an early end costs fitted sequences and no piece.
    """
    n = len(counts)
    want = counts.astype(float)
    want[0] = 0
    x = np.full(len(found), max(1e-9, want.sum() / max(1, 3 * len(found))))
    used = found > 0
    up = np.where(used, want[found], 0).sum(1)
    for _ in range(rounds):
        made = np.bincount(found.ravel(), np.repeat(x, 3) * used.ravel(), n)
        down = np.where(used, made[found], 0).sum(1)
        old = x
        x = x * up / np.maximum(down, 1e-12)
        if np.abs(x - old).max(initial=0) <= settled * x.max(initial=0):
            break
    return x


@dataclass
class Plan:
    """Where pieces go: for the pieces of a length from rank ``first`` on, ``count`` sequences from ``base`` on, at ``offset``."""

    key: np.ndarray  # length << 40 | first, ascending
    base: np.ndarray
    count: np.ndarray
    offset: np.ndarray
    sequences: int
    fitted: int = 0  # pieces in patterns of two or three lengths that the fit chose

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length << 40 | rank, "right") - 1
        return self.base[k] + rank - (self.key[k] & ((1 << 40) - 1)), self.offset[k]


#: The fits that are tried: (times that it is repeated on what is left, whether a count's fraction is carried on to the next pattern, most lengths in a pattern).
FITS = [(3, True, 3), (1, True, 3), (1, False, 3), (1, False, 2)]


def plan(counts: np.ndarray, size: int = SEQUENCE) -> Plan:
    """From the number of pieces of each length 0 to ``size``: of the ``FITS``, the one with the fewest sequences, ties by the order of the list."""
    best = None
    least = -(-int((counts.astype(np.int64) * np.arange(size + 1)).sum()) // size)
    for fits, carried, most in FITS:
        got = _plan(counts, size, fits, carried, most)
        if best is None or got.sequences < best.sequences:
            best = got
        if best.sequences == least:  # no packing can have fewer
            break
    return best


def _rounded(found: np.ndarray, x: np.ndarray, left: np.ndarray, carried: bool, last: bool) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, within what is left of each length, which is reduced by it.

    Carried: what a count loses goes on to the next pattern of the same longest length, so that many small counts are not all rounded to nothing; only the last time is a half rounded up.
    """
    runs = []
    carry, longest = 0.0, 0
    for k in (np.lexsort((-x, -found[:, 0])) if carried else np.argsort(-x, kind="stable")).tolist():
        own = [int(v) for v in found[k] if v]
        carry, longest = (carry if carried and own[0] == longest else 0.0) + float(x[k]), own[0]
        times = int(carry + (0.5 if last else 0.0))
        if not times and not carried:
            break
        for v in set(own) if times else ():
            times = min(times, int(left[v]) // own.count(v))
        if times:
            carry -= times
            runs.append((tuple(own), times))
            for v in own:
                left[v] -= times
    return runs


def _plan(counts: np.ndarray, size: int, fits: int, carried: bool, most: int) -> Plan:
    left = counts.astype(np.int64).copy()
    left[0] = 0
    runs: list[tuple[tuple[int, ...], int]] = []  # lengths in a sequence, and how many such sequences
    if left[size]:
        runs.append(((size,), int(left[size])))
        left[size] = 0
    for k in range(fits):
        found = patterns(left, size)
        found = found[(found > 0).sum(1) <= most]
        if len(found):
            runs += _rounded(found, fit(found, left), left, carried, k == fits - 1)
    fitted = sum(len(own) * times for own, times in runs if len(own) > 1)
    # Best fit, longest first: open sequences by the room they have, in runs of equal ones.
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    free = 0  # bit r: some sequence has room r
    for v in range(size - 1, 0, -1):
        n = int(left[v])
        while n:
            fits = free >> v
            if fits:
                r = v + (fits & -fits).bit_length() - 1
                own, times = room[r].pop()
                take = min(times, n)
                if take < times:
                    room[r].append((own, times - take))
                more = (*own, v)
            else:
                k = size // v
                take, each = (n // k, k) if n >= k else (1, n)
                r, more = size, (v,) * each
                room[size - v * each].append((more, take))
                free |= 1 << (size - v * each)
                n -= take * each
                continue
            if not room[r]:
                free &= ~(1 << r)
            room[r - v].append((more, take))
            free |= 1 << (r - v)
            n -= take
    runs += [x for some in room for x in some]
    key, base, count, offset, first = [], [], [], [], [0] * (size + 1)
    total = 0
    for own, times in runs:
        at = 0
        for v in own:
            key.append(v << 40 | first[v])
            base.append(total)
            count.append(times)
            offset.append(at)
            first[v] += times
            at += v
        total += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return Plan(*[np.array(x, np.int64)[order] for x in (key, base, count, offset)], total, fitted)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]): a row for each piece, each in one sequence, gapless from 0.

    with_ids adds the token ids, so that a sequence is its pieces' ids by offset. Null texts are empty; repeated rows are packed each; an
    empty table gives no rows; other columns are ignored. Which of equally long pieces takes which place follows the order of partitions and rows. A text is encoded whole by
    its task, but for cuts where no token can span.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, id_col, text_col, tokenizer, size, end, with_ids), "pieces")
    by_part = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(size + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        counts[r["length"]] = r.n
    held = spark.sparkContext.broadcast(plan(counts, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(begins, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for batch in batches:
            to, at = plan.place(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(to), pa.array(at)], [*names, "sequence_id", "offset"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.select(*names).schema] + ["sequence_id long, offset long"])
    order = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return ranked.mapInArrow(run, schema).select(F.col("id").alias(id_col), *order)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places; null and empty texts are one piece of the end id."""
    return packed(table(spark, sf_dir, "documents"))

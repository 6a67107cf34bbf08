"""Benchmark decontamination with suffix arrays of the training words.

Every block of training texts (a shard) gets a suffix array over its word hashes, ordered by prefix doubling
to a depth of 16 words. All suffixes of all benchmark items are looked up in it by binary search, one word
further at a time, so that each keeps the range of training suffixes that begin with its words so far.
A suffix that reaches the window's length has verbatim copies at the range's places. Beyond the sorted depth, matches are
followed word by word to their full lengths.

Shards hold whole texts, so all that concerns a document is found in one task: there is no shuffle, and
no shared state but the benchmark, which lies in the shared folder in blocks of at most ``ITEM_WORDS`` words. A shard's suffix array is made
once and meets one block after another.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import blocks, fresh, in_batches, opened, scratch_path, table, utf8

WINDOW = 10
DEPTH = 16
ITEM_WORDS = 2_000_000
SHARD_BYTES = 2 << 20
#: Occurrences of benchmark suffixes that a task expands at a time.
PAIRS = 1 << 20


@dataclass
class Items:
    """A block of benchmark items: word hashes of all, where each begins, and its id as text."""

    hashes: np.ndarray
    first: np.ndarray
    names: list[str]
    order: np.ndarray  # of each item its rank by id


def items(rows: list[tuple[str, str]]) -> Items:
    """From (id, text); items without words are left out."""
    raw = pa.array([t for _, t in rows], pa.string())
    data, at = utf8(raw)
    low = W.LOWER[data]
    found = W.split(low, at, W.ALNUM)
    hashes = W.span_hashes(low, found.starts, found.ends)
    some = np.flatnonzero(found.counts())
    names = [rows[i][0] for i in some]
    order = np.zeros(len(names), np.int64)
    order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    return Items(hashes, np.append(found.first[some], len(hashes)), names, order)


def suffix_array(hashes: np.ndarray, row: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Word positions ordered by the up to ``depth`` words that follow within the same row."""
    n = len(hashes)
    _, rank = np.unique(hashes, return_inverse=True)
    rank = rank.astype(np.int64) + 1  # zero: the row has ended
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < depth:
        after = np.zeros(n, np.int64)
        after[: n - step] = np.where(row[step:] == row[: n - step], rank[step:], 0) if n > step else 0
        pair = rank * np.int64(n + 2) + after
        order = np.argsort(pair, kind="stable")
        changed = np.ones(n, np.int64)
        changed[1:] = pair[order[1:]] != pair[order[:-1]]
        rank[order] = np.cumsum(changed)
        step *= 2
        if rank.max(initial=0) == n:
            break
    return order


def _bounds(key_at, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of ``want`` within each lo:hi, all at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        key = key_at(mid, live)
        up = key <= want[live] if right else key < want[live]
        lo[live[up]] = mid[up] + 1
        hi[live[~up]] = mid[~up]


@dataclass
class Hits:
    """Where the windows of a block stand in a shard: per position of the shard's suffix array, and per benchmark suffix."""

    order: np.ndarray  # the suffix array
    item: np.ndarray  # of each suffix that was found
    at: np.ndarray  # its word in the block
    need: np.ndarray  # its window's length
    lo: np.ndarray  # its range of the suffix array
    hi: np.ndarray


@dataclass
class Shard:
    """A block of training texts: word hashes, rows, and what its suffix array and binary searches need; made once for all benchmark blocks."""

    hashes: np.ndarray
    row: np.ndarray
    order: np.ndarray
    last: np.ndarray  # where the row of each word ends
    values: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, row: np.ndarray, window: int) -> Shard:
        values, rank = np.unique(hashes, return_inverse=True)
        return cls(hashes, row, suffix_array(hashes, row, max(DEPTH, window)), np.searchsorted(row, row, "right"), values, rank)


def search(shard: Shard, bench: Items, window: int = WINDOW) -> Hits:
    """The benchmark suffixes whose first window stands in the shard, each with its range of the suffix array."""
    order, rank, last, values = shard.order, shard.rank, shard.last, shard.values
    n = len(order)
    none = np.zeros(0, np.int64)
    if not n or not len(bench.names):
        return Hits(order, none, none, none, none, none)
    lengths = np.diff(bench.first)
    item = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(bench.first[0], bench.first[-1])
    need = np.minimum(window, lengths[item])
    go = bench.first[item + 1] - at >= need
    item, at, need = item[go], at[go], need[go]

    # The order of words is that of their hashes; a suffix that has ended comes first, as -1 in this signed order.
    where = np.searchsorted(values, bench.hashes)
    coded = np.where((where < len(values)) & (values[np.minimum(where, len(values) - 1)] == bench.hashes), where, -2)

    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), n, np.int64)
    live = np.arange(len(at))
    first_rank = rank[order]
    reached: list[np.ndarray] = []
    for d in range(int(need.max(initial=0))):
        want = coded[at[live] + d]
        live, want = live[want >= 0], want[want >= 0]
        if not len(live):
            break
        if d == 0:
            a, b = np.searchsorted(first_rank, want, "left"), np.searchsorted(first_rank, want, "right")
        else:

            def key_at(mid, which, d=d):
                p = order[mid] + d
                return np.where(p < last[order[mid]], rank[np.minimum(p, n - 1)], -1)

            a = _bounds(key_at, lo[live], hi[live], want, False)
            b = _bounds(key_at, a, hi[live], want, True)
        lo[live], hi[live] = a, b
        live = live[a < b]
        done = need[live] == d + 1
        reached.append(live[done])
        live = live[~done]
    hit = np.sort(np.concatenate(reached)) if reached else none
    return Hits(order, item[hit], at[hit], need[hit], lo[hit], hi[hit])


def covered(hits: Hits, n: int) -> np.ndarray:
    """Whether each of the shard's n words is inside an occurrence of a window; by ranges, not by occurrence of each item."""
    cover = np.zeros(n + 1, np.int64)
    for k in np.unique(hits.need).tolist():
        some = hits.need == k
        within = np.zeros(len(hits.order) + 1, np.int64)
        np.add.at(within, hits.lo[some], 1)
        np.add.at(within, hits.hi[some], -1)
        place = hits.order[np.cumsum(within[:-1]) > 0]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + k, -1)
    return np.cumsum(cover[:-1]) > 0


def _expanded(hits: Hits, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, place): every found suffix with the places of its range, about ``most`` at a time."""
    many = hits.hi - hits.lo
    total = np.concatenate([[0], np.cumsum(many)])
    i = 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        for a in range(0, int(many[i]) if j == i + 1 else 1, most):  # one suffix with many places in pieces
            if j == i + 1:
                place = hits.order[hits.lo[i] + a : min(hits.hi[i], hits.lo[i] + a + most)]
                yield np.full(len(place), i), place
            else:
                which = np.repeat(np.arange(i, j), many[i:j])
                yield which, hits.order[np.repeat(hits.lo[i:j], many[i:j]) + np.arange(len(which)) - np.repeat(total[i:j] - total[i], many[i:j])]
        i = j


def found_in(shard: Shard, bench: Items, hits: Hits, rows: int, most: int = PAIRS) -> tuple[list[set[int]], list[tuple[int, int, str] | None]]:
    """Of each row its items, by number, and (-length, place, item) of its longest verbatim match, the first of them and then the least item.

    A match whose word before agrees too is a part of the longer one that begins there, so only the others are followed to their end.
    """
    items_of: list[set[int]] = [set() for _ in range(rows)]
    best: list[tuple[int, int, str] | None] = [None] * rows
    hashes, row, last = shard.hashes, shard.row, shard.last
    for which, place in _expanded(hits, most):
        own = row[place]
        for r, i in np.unique(np.stack([own, hits.item[which]]), axis=1).T.tolist():
            items_of[r].add(i)
        at, item = hits.at[which], hits.item[which]
        begin = (place == 0) | (at == bench.first[item])
        begin[place > 0] |= row[place[place > 0] - 1] != own[place > 0]
        begin |= hashes[np.maximum(place - 1, 0)] != bench.hashes[np.maximum(at - 1, 0)]
        head = np.flatnonzero(begin)
        own, place, at, item, size = own[head], place[head], at[head], item[head], hits.need[which[head]].copy()
        left = bench.first[item + 1] - at
        on = np.arange(len(head))
        while len(on):
            ok = (place[on] + size[on] < last[place[on]]) & (size[on] < left[on])
            on = on[ok]
            on = on[hashes[place[on] + size[on]] == bench.hashes[at[on] + size[on]]]
            size[on] += 1
        by = np.lexsort((bench.order[item], place, -size, own))
        for h in by[np.unique(own[by], return_index=True)[1]].tolist():
            r = int(own[h])
            got = (-int(size[h]), int(place[h]), bench.names[item[h]])
            if best[r] is None or got < best[r]:
                best[r] = got
    return items_of, best


def _blocks_of(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The items in lists of about ``most`` words at most; the driver holds two lists at a time."""
    rows, held = [], 0
    wanted = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    for r in wanted.toLocalIterator():
        n = len(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", r.t))
        if rows and held + n > most:
            yield rows
            rows, held = [], 0
        rows.append((r.i if r.i is not None else "", r.t))
        held += n
    if rows:
        yield rows


def _written(spark: SparkSession, benchmark: DataFrame, id_col: str, text_col: str, most: int) -> list[str]:
    """Paths of the benchmark's blocks in the shared folder, from which every task reads them one after another."""
    folder, paths = scratch_path(spark, "benchmark"), []
    for k, rows in enumerate(_blocks_of(benchmark, id_col, text_col, most)):
        paths.append(f"{folder}/{k}.bin")
        store, place = opened(paths[-1])
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place, compression=None) as out:
            out.write(pickle.dumps(items(rows)))
    return paths


_held: dict[str, Items] = {}


def _block(path: str) -> Items:
    """A benchmark block; the process keeps the last one that it read."""
    if path not in _held:
        store, place = opened(path)
        with store.open_input_stream(place, compression=None) as f:
            got = pickle.loads(f.read())
        _held.clear()
        _held[path] = got
    return _held[path]


RESULT = ["n_words", "n_hit", "items", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at", "longest_item"]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, item_words: int = ITEM_WORDS) -> DataFrame:
    """(row columns of docs, n_words, n_hit, items, n_items, items_sha256, contaminated, longest_match, longest_at, longest_item).

    Words are runs of digits, letters and bytes from 0x80 on, A-Z lower-cased. A window is ``window`` consecutive words of an
    item, or a whole shorter item; items without words have none. n_hit counts the words inside any copy of a window;
    longest_match is the longest verbatim match that has a window's length at least (else 0), at word longest_at
    of longest_item; of equally long ones the first, and there the least item. Null texts have no words. Repeated rows each get a row; repeated item ids count
    once, a null id as the empty text; an empty benchmark hits nothing. Columns of docs with these names are replaced. A text is held whole by its
    task. Results don't depend on ``item_words``, the most words of the benchmark that a task holds at a time.
    """
    keep = [c for c in docs.columns if c not in RESULT]
    paths = _written(docs.sparkSession, benchmark, item_col, item_text, item_words)
    out = docs.select(*keep).schema
    names = [f.name for f in out]
    extra = "n_words long, n_hit long, items array<string>, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_at long, longest_item string"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out] + [extra])

    def shard_rows(lo: int, hi: int, raw: np.ndarray, where: np.ndarray) -> Iterator[tuple]:
        low = W.LOWER[raw]
        got = W.split(low, where, W.ALNUM)
        shard = Shard.of(W.span_hashes(low, got.starts, got.ends), got.row, window)
        inside = np.zeros(len(shard.hashes), bool)
        names_of: list[set[str]] = [set() for _ in range(hi - lo)]
        best: list[tuple[int, int, str] | None] = [None] * (hi - lo)
        for path in paths if len(shard.hashes) else ():
            bench = _block(path)
            hits = search(shard, bench, window)
            if not len(hits.at):
                continue
            inside |= covered(hits, len(inside))
            numbers, longest = found_in(shard, bench, hits, hi - lo)
            for r in range(hi - lo):
                names_of[r].update(bench.names[i] for i in numbers[r])
                if longest[r] is not None and (best[r] is None or longest[r] < best[r]):
                    best[r] = longest[r]
        total = np.concatenate([[0], np.cumsum(inside)])
        n_hit = total[got.first[1:]] - total[got.first[:-1]]
        for r in range(hi - lo):
            found, top = sorted(names_of[r]), best[r]
            yield int(got.first[r + 1] - got.first[r]), int(n_hit[r]), found, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(n_hit[r]), -top[0] if top else 0, top[1] - int(got.first[r]) if top else 0, top[2] if top else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            data, at = utf8(batch.column(len(names)))
            rows = [r for block in blocks(data, at, SHARD_BYTES) for r in shard_rows(*block)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], [*names, *RESULT])

    return in_batches(docs).select(*keep, F.col(text_col).cast("string").alias(fresh(docs, "__text")[0])).mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no benchmark window occurs in, with their own columns."""
    clash = [c for c in docs.columns if c.lower() in RESULT]
    names = dict(zip(clash, fresh(docs, *[f"__own_{c}" for c in clash])))  # carried under other names
    found = overlaps(docs.withColumnsRenamed(names), benchmark, **options).filter("NOT contaminated").drop(*RESULT)
    return found.withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """What ``overlaps`` finds in every document, without the item list; null texts have no words and are not contaminated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_at", "longest_item")

"""Removal of long verbatim repeats with a run-length compressed Burrows-Wheeler index.

A byte goes if a string of ``SPAN`` bytes that covers it also starts anywhere else, in the same text or another one. Strings are judged on the input.

Dealing the work: the start of every SPAN-byte string is given to its minimizer, the least hash of ``SEED`` bytes within it (the leftmost of equal ones). Starts that follow
one another with the same minimizer are one stretch. Equal strings have equal minimizers, so all copies of a string are
found within the stretches of one minimizer, and a minimizer that occurs once has no repeats. Stretches are known by hashes at first; equal stretches are repeats as they are, and only
minimizers with unlike stretches need their bytes, each distinct stretch once.

The index: tasks take whole minimizers in blocks of at most ``BLOCK`` bytes, sort the suffixes, and run-length encode the Burrows-Wheeler
transform. At the ends of runs, and only there, the text position and the common prefix with the neighbour beyond the run are sampled. Matching statistics
are streamed in text order from those samples (one less for each step), and matches of SPAN bytes or more are marked. In repetitive texts runs are few.

Minimizers with over ``HOT`` distinct stretches (one passage in very many surroundings) would be one task's; theirs are counted
string by string, by hash, over all tasks, which finds the same bytes.

Texts are written once to the shared folder and never shuffled; what concerns a part of them is written beside it, by part, and read by the task that scans it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import blocks, in_batches, opened, scratch_path, stored, table, utf8

SPAN = 200
SEED = 64
BLOCK = 1 << 20
HOT = 4096
#: Bytes of a text whose stretches are looked for at a time; positions within have 20 bits.
PIECE = 1 << 17
#: Rows of a part of the stored texts have so many bits in Spark's increasing ids.
PART_BITS = 33


# ---------------------------------------------------------------- stretches


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima from both ends of blocks."""
    n = len(hashes)
    if width == 1:
        return hashes
    square = np.concatenate([hashes, np.full(-n % width, np.iinfo(hashes.dtype).max, hashes.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _rolling(data: np.ndarray) -> np.ndarray:
    """Sums whose differences are hashes of byte ranges."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(W._VALUE[data] * W.powers(W._BASE, len(data)), out=total[1:])
    return total


def stretches(data: np.ndarray, at: np.ndarray, span: int = SPAN, seed: int = SEED) -> list[np.ndarray]:
    """Of the rows that begin ``at``, columns: row, mini, whole, start, length, reach, times.

    A stretch is the text from the first of its strings' start to the last one's end; whole is its hash. Where equal stretches follow one another (a text that goes round), they are one entry that
    counts them in times, up to reach.
    """
    width = span - seed + 1
    out: list[list[np.ndarray]] = []
    for lo, hi, raw, where in blocks(data, at, PIECE):
        for c in range(0, max(1, len(raw) - span + 1), PIECE):  # only a block of one long row has several pieces
            piece, begins = (raw, where) if len(raw) <= 2 * PIECE - span else (raw[c : c + PIECE + span - 1], None)
            n = len(piece)
            if n < span:
                continue
            total, unbase = _rolling(piece), W.powers(W._UNBASE, n + 1)
            hashes = W.mix((total[seed:] - total[:-seed]) * unbase[: n - seed + 1])
            best = _least(hashes & np.uint64(0xFFFFFFFFFFF00000) | np.arange(len(hashes), dtype=np.uint64), width)
            place = (best & np.uint64(0xFFFFF)).astype(np.int64)
            starts = np.arange(len(place))
            if begins is None:
                row, inside = np.zeros(len(place), np.int64), np.ones(len(place), bool)
                home = np.array([-c])
            else:
                row = np.repeat(np.arange(hi - lo), np.diff(begins))[: len(place)]
                inside = begins[row + 1] - starts >= span
                home = begins
            change = np.ones(len(place), bool)
            change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            change |= ~inside
            first = np.flatnonzero(change)
            last = np.append(first[1:], len(place))
            ok = inside[first]
            first, last = first[ok], last[ok]
            end = last + span - 1
            mini, whole = hashes[place[first]], W.mix((total[end] - total[first]) * unbase[first] + (end - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            rows = row[first]
            # Runs of equal stretches.
            head = np.ones(len(first), bool)
            head[1:] = (mini[1:] != mini[:-1]) | (whole[1:] != whole[:-1]) | (rows[1:] != rows[:-1])
            h = np.flatnonzero(head)
            tail = np.append(h[1:], len(first)) - 1
            base = home[rows[h]]
            out.append([rows[h] + lo, mini[h].view(np.int64), whole[h].view(np.int64), first[h] - base, (end - first)[h], end[tail] - base, tail - h + 1])
            if begins is not None:
                break
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 7


# ---------------------------------------------------------------- run-length index


def suffix_order(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions by the bytes that follow within the same text (``ends``: of each position its text's end); an ended suffix comes first, equal ones stand together."""
    n = len(data)
    left = ends - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(7):  # seven bytes, then how many of them there are
        key = key << np.uint64(8) | np.where(left > k, padded[k : k + n], 0).astype(np.uint64)
    key = key << np.uint64(4) | np.minimum(left, 7).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth, most = 7, int(left.max(initial=0))
    live = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of order whose group has others
    while len(live) and depth < most:
        own = order[live]
        after = np.where(left[own] > depth, rank[np.minimum(own + depth, n - 1)] + 1, 0)
        both = rank[own] * np.int64(n + 2) + after
        by = np.argsort(both, kind="stable")
        order[live] = own[by]  # groups keep their places
        both = both[by]
        head = np.ones(len(live), bool)
        head[1:] = both[1:] != both[:-1]
        rank[order[live]] = np.maximum.accumulate(np.where(head, live, 0))
        live = live[~(head & np.append(head[1:], True))]
        depth *= 2
    return order


def common_prefix(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b share, within their texts; eight at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    limit = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        same = np.cumprod(eight[a[live] + out[live]] == eight[b[live] + out[live]], axis=1, dtype=np.int8).sum(1)
        out[live] += same
        live = live[(same == 8) & (out[live] < limit[live])]
    return np.minimum(out, limit)


def run_samples(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the run-length compressed transform of the texts that begin at ``first`` (with the end as last entry): the text positions at the ends of its runs, and what each shares with the neighbour beyond.

    (positions at run heads, positions at the tails before them, bytes in common). A text's own begin has no byte before it and is a run of its own.
    """
    n = len(data)
    ends = np.repeat(first[1:], np.diff(first))
    order = suffix_order(data, ends)
    before = np.full(n, 256, np.int16)
    before[1:] = data[:-1]
    before[first[:-1][first[:-1] < n]] = 256
    bwt = before[order]
    heads = 1 + np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == 256))
    a, b = order[heads], order[heads - 1]
    return a, b, common_prefix(data, ends - np.arange(n), a, b)


def matching_statistics(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each position the bytes from it on that occur elsewhere too, streamed from the samples at run ends.

    A sample's neighbours agree up to its length; each step on leaves one byte less, until a longer sample takes over.
    """
    a, b, shared = run_samples(data, first)
    n = len(data)
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, a, a + shared)
    np.maximum.at(reach, b, b + shared)
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def runs_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    step = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def marked(texts: list[bytes], span: int = SPAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the (starts, ends) of the bytes inside strings of ``span`` bytes that occur elsewhere among the texts, or at another place of the same."""
    first = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [(np.zeros(0, np.int64),) * 2 for _ in texts]
    # Reaches never pass a text's end, so what streams over it is at most zero there.
    long = matching_statistics(data, first) >= span
    cover = np.zeros(len(data) + 1, np.int64)
    at = np.flatnonzero(long)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + span, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return [runs_of(inside[x:y]) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]


# ---------------------------------------------------------------- Spark


def _beside(rows: DataFrame, what: str) -> str:
    """Write rows (part, ...) by part beside the texts; the folder."""
    folder = scratch_path(rows.sparkSession, what)
    rows.repartition("part").write.partitionBy("part").parquet(folder)
    return folder


class _Beside:
    """Rows of the parts of a folder, sorted by row; the last part is kept."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names, self.part = folder, names, None

    def of(self, part: int) -> dict[str, np.ndarray]:
        if part != self.part:
            from pyarrow.fs import FileSelector

            store, place = opened(f"{self.folder}/part={part}")
            files = [f for f in store.get_file_info(FileSelector(place, allow_not_found=True)) if f.base_name.endswith(".parquet")]
            parts = [pq.ParquetFile(store.open_input_file(f.path)).read(self.names) for f in files]
            found = {c: np.concatenate([t[c].to_numpy() for t in parts]) if parts else np.zeros(0, np.int64) for c in self.names}
            by = np.argsort(found["row"], kind="stable")
            self.part, self.held = part, {c: v[by] for c, v in found.items()}
        return self.held

    def rows(self, part: int, row: int) -> tuple[dict[str, np.ndarray], slice]:
        held = self.of(part)
        return held, slice(int(np.searchsorted(held["row"], row)), int(np.searchsorted(held["row"], row, "right")))


def _texts(texts: DataFrame) -> DataFrame:
    return in_batches(texts).select("part", "row", "text")


def found_stretches(texts: DataFrame, span: int, seed: int) -> DataFrame:
    """(part, row, mini, whole, start, length, reach, times) of the stored texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "row", "mini", "whole", "start", "length", "reach", "times"]
        for batch in batches:
            row, *rest = stretches(*utf8(batch["text"]), span, seed)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch["part"].take(row), batch["row"].take(row), *[pa.array(x.astype(np.int64)) for x in rest]], names)

    return _texts(texts).mapInArrow(run, "part long, row long, mini long, whole long, start long, length long, reach long, times long")


def cut_out(texts: DataFrame, folder: str) -> DataFrame:
    """(mini, whole, bytes) of the stretches that ``folder`` lists by part: (row, start, length, mini, whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _Beside(folder, ["row", "start", "length", "mini", "whole"])
        for batch in batches:
            data, at = utf8(batch["text"])
            mini, whole, own = [], [], []
            for k, (part, row) in enumerate(zip(batch["part"].to_pylist(), batch["row"].to_pylist())):
                held, some = listed.rows(part, row)
                if some.start == some.stop:
                    continue
                text = data[at[k] : at[k + 1]].tobytes()
                own += [text[a : a + n] for a, n in zip(held["start"][some].tolist(), held["length"][some].tolist())]
                mini.append(held["mini"][some])
                whole.append(held["whole"][some])
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(mini)), pa.array(np.concatenate(whole)), pa.array(own, pa.binary())], ["mini", "whole", "own"])

    return _texts(texts).mapInArrow(run, "mini long, whole long, own binary")


SPANS = "mini long, whole long, a long, b long"


def indexed(cut: DataFrame, span: int, block: int = BLOCK) -> DataFrame:
    """(mini, whole, a, b): the repeats a:b within each stretch, from run-length indexes over whole minimizers."""

    def spans(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        mini, whole, starts, ends = [], [], [], []
        for (m, w, _), (a, b) in zip(held, marked([x for *_, x in held], span)):
            mini += [m] * len(a)
            whole += [w] * len(a)
            starts.append(a)
            ends.append(b)
        columns = [pa.array(mini, pa.int64()), pa.array(whole, pa.int64()), *[pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (starts, ends)]]
        return pa.RecordBatch.from_arrays(columns, ["mini", "whole", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(batch["mini"].to_pylist(), batch["whole"].to_pylist(), batch["own"].to_pylist()):
                if size > block and row[0] != last:
                    yield spans(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
                last = row[0]
        if held:
            yield spans(held)

    return in_batches(cut.repartition("mini").sortWithinPartitions("mini")).mapInArrow(run, SPANS)


def _cores(own: bytes, mini: int, span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, owners) of a stretch's strings: of each string its begin, its hash, and the hash of its core.

    A core is what a string holds on both sides of its minimizer, cut down to multiples of an eighth of their length, so each string has one core, and neighbouring strings share it.
    """
    data = np.frombuffer(own, np.uint8)
    n = len(data)
    total, unbase = _rolling(data), W.powers(W._UNBASE, len(data) + 1)
    of = lambda a, b: (total[b] - total[a]) * unbase[a]
    first = max(0, n - span)  # the minimizer lies in every string
    seeds = np.arange(first, min(n, span) - seed + 1)
    at = int(seeds[np.flatnonzero(W.mix(of(seeds, seeds + seed)).view(np.int64) == mini)[0]])
    step = max(1, (span - seed) // 8)
    places = np.arange(n - span + 1)
    left, right = (at - places) // step, (places + span - at - seed) // step
    core = W.mix(of(at - left * step, at + seed + right * step) + (left * 64 + right).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return places, W.mix(of(places, places + span)).view(np.int64), core.view(np.int64)


def counted(cut: DataFrame, span: int, seed: int) -> DataFrame:
    """As ``indexed``, by counting the hashes of strings, for minimizers too large for one task.

    Cores are counted first, a few for each stretch; strings whose core stands once are no repeats, and only the others are counted themselves.
    """

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_cores(x, m, span, seed)[2]) for m, x in zip(batch["mini"].to_pylist(), batch["own"].to_pylist())]
            sizes = pa.array(np.repeat(np.arange(len(found)), [len(k) for k in found]))
            yield pa.RecordBatch.from_arrays([batch["mini"].take(sizes), batch["whole"].take(sizes), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["mini", "whole", "core"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, keys, sizes = [], [], []
            for m, x, some in zip(batch["mini"].to_pylist(), batch["own"].to_pylist(), batch["cores"].to_pylist()):
                at, string, core = _cores(x, m, span, seed)
                keep = np.isin(core, np.array(some, np.int64))
                places.append(at[keep])
                keys.append(string[keep])
                sizes.append(int(keep.sum()))
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            joined = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (keys, places)]
            yield pa.RecordBatch.from_arrays([batch["mini"].take(rows), batch["whole"].take(rows), *joined], ["mini", "whole", "string", "a"])

    own = stored(in_batches(cut).select("mini", "whole", "own").mapInArrow(cores, "mini long, whole long, core long"), "cores")
    twice = own.groupBy("mini", "core").agg(F.count("*").alias("n")).filter("n > 1").select("mini", "core")
    alive = own.join(twice, ["mini", "core"], "left_semi").groupBy("mini", "whole").agg(F.collect_list("core").alias("cores"))
    every = stored(cut.join(alive, ["mini", "whole"]).select("mini", "whole", "own", "cores").mapInArrow(strings, "mini long, whole long, string long, a long"), "strings")
    often = every.groupBy("mini", "string").agg(F.count("*").alias("n")).filter("n > 1").select("mini", "string")
    return every.join(often, ["mini", "string"], "left_semi").select("mini", "whole", "a", (F.col("a") + span).alias("b"))


def repeats(texts: DataFrame, span: int = SPAN, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(part, row, a, b): byte ranges, overlapping ones among them, whose union is what occurs elsewhere in strings of ``span`` bytes; of stored texts (part, row, text)."""
    every = stored(found_stretches(texts, span, seed), "stretches")
    often = every.groupBy("mini").agg(F.sum("times").alias("n"), F.min("whole").alias("x"), F.max("whole").alias("y")).filter("n > 1").select("mini", (F.col("x") != F.col("y")).alias("unlike"))
    hits = stored(every.join(often, "mini"), "hits")
    alike = hits.filter("NOT unlike").select("part", "row", F.col("start").alias("a"), F.col("reach").alias("b"))
    unlike = hits.filter("unlike")
    one = F.min(F.struct("part", "row", "start", "length")).alias("one")
    distinct = stored(unlike.groupBy("mini", "whole").agg(F.sum("times").alias("n"), one), "distinct")
    cut = stored(cut_out(texts, _beside(distinct.select("one.*", "mini", "whole"), "wanted")), "cut")
    crowds = distinct.groupBy("mini").agg(F.count("*").alias("m")).filter(F.col("m") > hot).select("mini")
    large = not crowds.isEmpty()
    crowds = stored(crowds, "crowds") if large else None
    spans = indexed(cut.join(crowds, "mini", "left_anti") if large else cut, span)
    if large:
        spans = spans.union(counted(stored(cut.join(crowds, "mini", "left_semi"), "crowded"), span, seed))
    # Whole stretches that occur several times need no spans of their own.
    several = distinct.filter("n > 1").select("mini", "whole", F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    once = distinct.filter("n = 1").select("mini", "whole")
    spans = stored(spans.join(once, ["mini", "whole"], "left_semi").union(several), "spans")
    own = unlike.join(spans.select("mini", "whole", F.col("a").alias("from"), F.col("b").alias("to")), ["mini", "whole"])
    shifted = own.select("part", "row", (F.col("start") + F.col("from")).alias("a"), F.when(F.col("to") < 0, F.col("reach")).otherwise(F.col("start") + F.col("to")).alias("b"))
    return alike.union(shifted)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(id_col, n_bytes, n_removed, removed array of (a, b), kept binary): a row for each row of docs; removed are the maximal byte runs that go, kept is what is left, concatenated.

    Null texts are empty and lose nothing, like all of fewer than ``span`` bytes. Equal rows of that length lose everything, as each has a copy elsewhere. kept is bytes, as a run may begin or end
    inside a character. An empty table gives no rows; ids may repeat or be null; other columns are ignored, so names can't clash. A text is held whole by its task. ``seed`` and ``hot`` don't change results.
    """
    if not 0 < seed <= span:
        raise ValueError("the seed must lie within the span")
    number = F.monotonically_increasing_id()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("part", F.shiftright(number, PART_BITS)).withColumn("row", number.bitwiseAND(F.lit((1 << PART_BITS) - 1)))
    texts = stored(given, "texts")
    folder = _beside(repeats(texts, span, seed, hot), "repeats")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = _Beside(folder, ["row", "a", "b"])
        spot = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            data, at = utf8(batch["text"])
            size, gone, kept = np.diff(at), np.zeros(batch.num_rows, np.int64), []
            edge, starts, ends = [0], [], []
            for k, (part, row) in enumerate(zip(batch["part"].to_pylist(), batch["row"].to_pylist())):
                text = data[at[k] : at[k + 1]]
                held, some = listed.rows(part, row)
                if some.start < some.stop:
                    cover = np.zeros(len(text) + 1, np.int64)
                    np.add.at(cover, held["a"][some], 1)
                    np.add.at(cover, held["b"][some], -1)
                    inside = np.cumsum(cover[:-1]) > 0
                    a, b = runs_of(inside)
                    gone[k] = inside.sum()
                    starts.append(a)
                    ends.append(b)
                    edge.append(edge[-1] + len(a))
                    text = text[~inside]
                else:
                    edge.append(edge[-1])
                kept.append(text.tobytes())
            joined = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (starts, ends)]
            removed = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays(joined, fields=list(spot)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(size), pa.array(gone), removed, pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "removed", "kept"])

    schema = f"id {kind}, n_bytes long, n_removed long, removed array<struct<a:long,b:long>>, kept binary"
    return in_batches(texts).select("id", "part", "row", "text").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_repeats(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document: 200-byte strings that start anywhere else are removed.

    Null texts are empty; documents without repeats keep everything; equal documents of 200 bytes or more keep nothing.
    """
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""Binary alignment files as a Spark data source: ``spark.read.format("bam")`` and ``df.write.format("bam")``.

A file is a row of BGZF blocks, each a gzip member of at most 64 KiB with its size in an extra field. A place in it is a virtual offset: where the block begins in the file, times 65,536, plus the
place within the block once it is inflated. The index beside a file (``.bai``) names the offsets where the reads of each bin of positions begin and end, and for each window of 16,384 bases the least
offset of a read that reaches into it.

Reading: the driver looks at headers and indexes only, and plans partitions of about ``split`` compressed bytes, cut at offsets that the index knows to be begins of records. With regions these are the
chunks that the index names for them. A partition takes the records that begin in its range, whichever block they end in, so a record is read once. Tasks inflate block by block, and decode whole batches of
records with numpy into Arrow. A file without an index is one partition, and regions are then a filter only.

Writing: every task writes one file with its index under a temporary name; the driver renames those of the tasks that succeeded. Rows must be sorted by the header's order of contigs and by position within a task
(``written`` does so) for an index to be made.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..shipping import ship
from .writers import files_for

SCHEMA = "name string, flags int, chromosome string, position long, mapq int, cigar string, mate_chromosome string, mate_position long, insert_size long, bases string, qualities string, tags map<string,string>, end long"
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
#: Fixed values of the format: base and operation letters by code, the operations that go on along the reference, the last block of a file, bases of a window of the linear index.
BASES, OPS, ALONG = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", "MDN=X"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
WINDOW = 14
BLOCK = 65_280
SPLIT = 32 << 20
BATCH = 20_000
#: The fields before a record's name, after its size.
FIXED = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flags", "<u2"), ("l_seq", "<i4"), ("mate_ref", "<i4"), ("mate_pos", "<i4"), ("size", "<i4")])


def opened(path: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path) if path.startswith("/") or "://" in path else fs.FileSystem.from_uri(path)


def bin_of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least bin that holds positions start to end (from 0, end excluded); bins are of 16 kb and of eight of the next smaller ones each."""
    out, last, first = np.zeros(len(start), np.int64), np.asarray(end) - 1, 4681
    done = np.zeros(len(start), bool)
    for shift in (14, 17, 20, 23, 26):
        same = ~done & (start >> shift == last >> shift)
        out[same] = first + (start[same] >> shift)
        done |= same
        first = (first - 1) >> 3
    return out


def bins_over(start: int, end: int) -> set[int]:
    """All bins that may hold a read over positions start to end."""
    out, first = {0}, 1
    for shift in (26, 23, 20, 17, 14):
        out.update(range(first + (start >> shift), first + ((end - 1) >> shift) + 1))
        first = first * 8 + 1
    return out


# ---------------------------------------------------------------- blocks


class Blocks:
    """Blocks of an open file from an offset on; ``read`` counts those that were inflated."""

    def __init__(self, source, begin: int = 0):
        self.source, self.at, self.read = source, begin, 0
        source.seek(begin)

    def next(self) -> tuple[int, bytes] | None:
        """The block's place and its bytes; none at the end."""
        head = self.source.read(12)
        if not head:
            return None
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block begins at {self.at}")
        extra = self.source.read(struct.unpack("<H", head[10:])[0])
        size, k = None, 0
        while k + 4 <= len(extra):
            n = struct.unpack("<H", extra[k + 2 : k + 4])[0]
            if extra[k : k + 2] == b"BC" and n == 2:
                size = struct.unpack("<H", extra[k + 4 : k + 6])[0] + 1
            k += 4 + n
        if size is None:
            raise ValueError(f"the gzip member at {self.at} has no block size")
        rest = self.source.read(size - 12 - len(extra))
        if len(rest) < size - 12 - len(extra):
            raise ValueError(f"the block at {self.at} is cut off")
        data = zlib.decompress(rest[:-8], -15)
        if struct.unpack("<II", rest[-8:]) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the block at {self.at} is damaged")
        place, self.at, self.read = self.at, self.at + size, self.read + 1
        return place, data


def block(data: bytes, level: int = 6) -> bytes:
    """``data``, at most 65,280 bytes, as one block."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    if len(body) > 65_500:  # what can't be deflated is stored
        pack = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = pack.compress(data) + pack.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Head:
    text: str
    contigs: list[tuple[str, int]]
    first: int  # virtual offset of the first record


def head_of(source) -> Head:
    blocks, data, places = Blocks(source), b"", []

    def need(n: int) -> None:
        nonlocal data
        while len(data) < n:
            got = blocks.next()
            if got is None:
                raise ValueError("the header is cut off")
            places.append((len(data), got[0]))
            data += got[1]

    need(8)
    if data[:4] != b"BAM\x01":
        raise ValueError("no binary alignment file")
    n = struct.unpack("<i", data[4:8])[0]
    need(12 + n)
    text, count, at = data[8 : 8 + n].rstrip(b"\0").decode(), struct.unpack("<i", data[8 + n : 12 + n])[0], 12 + n
    contigs = []
    for _ in range(count):
        need(at + 4)
        size = struct.unpack("<i", data[at : at + 4])[0]
        need(at + 8 + size)
        contigs.append((data[at + 4 : at + 3 + size].decode(), struct.unpack("<i", data[at + 4 + size : at + 8 + size])[0]))
        at += 8 + size
    if at == len(data):
        return Head(text, contigs, blocks.at << 16)
    begin, place = [x for x in places if x[0] <= at][-1]
    return Head(text, contigs, place << 16 | at - begin)


# ---------------------------------------------------------------- index


@dataclass
class Index:
    """Of each contig its bins' chunks of virtual offsets, and its windows' least offsets."""

    bins: list[dict[int, list[tuple[int, int]]]]
    windows: list[np.ndarray]

    @classmethod
    def parse(cls, raw: bytes) -> Index:
        if raw[:4] != b"BAI\x01":
            raise ValueError("no index")
        at, bins, windows = 8, [], []
        for _ in range(struct.unpack_from("<i", raw, 4)[0]):
            own: dict[int, list[tuple[int, int]]] = {}
            count, at = struct.unpack_from("<i", raw, at)[0], at + 4
            for _ in range(count):
                number, n = struct.unpack_from("<Ii", raw, at)
                pairs = np.frombuffer(raw, "<u8", 2 * n, at + 8).reshape(-1, 2)
                if number != 37450:  # a bin of counts, not of chunks
                    own[number] = [(int(a), int(b)) for a, b in pairs]
                at += 8 + 16 * n
            n = struct.unpack_from("<i", raw, at)[0]
            windows.append(np.frombuffer(raw, "<u8", n, at + 4).astype(np.int64))
            at += 4 + 8 * n
            bins.append(own)
        return cls(bins, windows)

    def chunks(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Ranges of offsets that hold all reads over positions start to end (from 0, end excluded)."""
        if ref >= len(self.bins):
            return []
        windows = self.windows[ref]
        least = int(windows[min(start >> WINDOW, len(windows) - 1)]) if len(windows) else 0
        if len(windows) and start >> WINDOW >= len(windows):
            least = 0
        own = self.bins[ref]
        wanted = bins_over(start, end)
        numbers = wanted & own.keys() if len(wanted) < len(own) else [b for b in own if b in wanted]
        return [(max(a, least), b) for k in numbers for a, b in own[k] if b > least]

    def begins(self) -> np.ndarray:
        """Offsets at which records are known to begin."""
        every = [a for own in self.bins for some in own.values() for a, _ in some]
        return np.unique(np.concatenate([np.array(every, np.int64), *self.windows])) if every else np.zeros(0, np.int64)


def joined(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(chunks):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# ---------------------------------------------------------------- records


def _texts(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(int(offsets[-1]))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def _cigars(codes: np.ndarray, count: np.ndarray) -> pa.Array:
    """Operations as text; ``*`` without any. Numbers stand in cells of equal width, of which the used part is kept."""
    size, op = codes >> 4, codes & 15
    digits = size[:, None] // 10 ** np.arange(8, -1, -1) % 10
    length = 1 + sum((size >= 10**k).astype(np.int64) for k in range(1, 9))
    cells = np.concatenate([(digits + 48).astype(np.uint8), np.frombuffer(OPS.encode(), np.uint8)[op][:, None]], axis=1)
    used = np.arange(10) >= (9 - length)[:, None]
    text = np.append(cells[used], np.uint8(42))
    edge = np.concatenate([[0], np.cumsum(length + 1)])[np.concatenate([[0], np.cumsum(count)])]
    starts, sizes = edge[:-1].copy(), np.diff(edge)
    starts[count == 0], sizes[count == 0] = len(text) - 1, 1
    return _texts(text, starts, sizes)


_TAG = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I", b"f": "<f"}


@functools.lru_cache(4096)
def _tags(raw: bytes) -> list[tuple[str, str]]:
    return list(tags_of(raw).items())


def tags_of(raw: bytes) -> dict[str, str]:
    """Values as the text format writes them; arrays with their kind first."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), raw[at + 2 : at + 3]
        at += 3
        if kind in (b"Z", b"H"):
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == b"A":
            out[name], at = chr(raw[at]), at + 1
        elif kind == b"B":
            sub, n = raw[at : at + 1], struct.unpack_from("<i", raw, at + 1)[0]
            values = np.frombuffer(raw, _TAG[sub][:1] + {"b": "i1", "B": "u1", "h": "i2", "H": "u2", "i": "i4", "I": "u4", "f": "f4"}[_TAG[sub][1]], n, at + 5)
            out[name], at = ",".join([sub.decode(), *(f"{v:g}" if sub == b"f" else str(v) for v in values.tolist())]), at + 5 + values.nbytes
        else:
            value = struct.unpack_from(_TAG[kind], raw, at)[0]
            out[name], at = f"{value:g}" if kind == b"f" else str(value), at + struct.calcsize(_TAG[kind])
    return out


def decoded(data: bytes, starts: np.ndarray, contigs: list[str], wanted: Wanted) -> pa.RecordBatch:
    """The records of ``data`` whose fields (after their size) begin at ``starts``, as far as they are wanted."""
    raw = np.frombuffer(data, np.uint8)
    sizes = np.frombuffer(raw[(starts[:, None] + np.arange(-4, 0))].tobytes(), "<i4").astype(np.int64)
    fixed = np.frombuffer(raw[starts[:, None] + np.arange(32)].tobytes(), FIXED)
    f = {k: fixed[k].astype(np.int64) for k in FIXED.names}
    at = starts + 32 + f["l_name"]
    count = f["n_cigar"]
    ops_at = np.repeat(at, count) + 4 * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    codes = np.frombuffer(raw[ops_at[:, None] + np.arange(4)].tobytes(), "<u4").astype(np.int64)
    along = np.where(np.isin(codes & 15, [OPS.index(x) for x in ALONG]), codes >> 4, 0)
    total = np.concatenate([[0], np.cumsum(along)])[np.concatenate([[0], np.cumsum(count)])]
    end = f["pos"] + np.diff(total)  # excluded
    keep = wanted.of(f["ref"], f["pos"], np.maximum(end, f["pos"] + 1), f["mapq"], f["flags"])
    # The operations of a cigar too long for its field stand in a tag.
    long = keep & (count == 2) & (np.bincount(np.repeat(np.arange(len(count)), count), (codes & 15 == 4) & (np.arange(len(codes)) == np.repeat(np.cumsum(count) - count, count)), len(count)) > 0)
    seq = at + 4 * count
    qual = seq + (f["l_seq"] + 1) // 2
    tail = qual + f["l_seq"]
    names = np.array([*contigs, "*"], object)
    k = np.flatnonzero(keep)
    of = lambda x: x[k]
    cigars = _cigars(codes[np.repeat(keep, count)], of(count))
    tags = [_tags(data[a:b]) for a, b in zip(of(tail).tolist(), (of(starts) + of(sizes)).tolist())] if wanted.tags else [[]] * len(k)
    ends = of(end).copy()
    if wanted.tags and (some := [i for i, t in enumerate(tags) if long[k[i]] and "CG" in dict(t)]):
        text = cigars.to_pylist()
        for i in some:
            own = np.array([int(x) for x in dict(tags[i])["CG"].split(",")[1:]], np.int64)
            tags[i] = [x for x in tags[i] if x[0] != "CG"]
            text[i] = _cigars(own, np.array([len(own)])).to_pylist()[0]
            ends[i] = f["pos"][k[i]] + int((own >> 4)[np.isin(own & 15, [OPS.index(x) for x in ALONG])].sum())
        cigars = pa.array(text, pa.string())
    # Bases, two in a byte.
    n = of(f["l_seq"])
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pair = raw[np.repeat(of(seq), n) + place // 2]
    letters = np.frombuffer(BASES.encode(), np.uint8)[np.where(place % 2 == 0, pair >> 4, pair & 15)]
    marks = raw[np.repeat(of(qual), n) + place]
    begin = np.cumsum(n) - n
    none = n == 0
    unknown = ~none & (np.append(marks, np.uint8(0))[np.where(none, len(marks), begin)] == 255)
    star = lambda values, gone: _texts(np.append(values, np.uint8(42)), np.where(gone, len(values), begin), np.where(gone, 1, n))
    mapping = pa.array(tags, pa.map_(pa.string(), pa.string()))
    columns = [
        _texts(raw, of(starts) + 32, of(f["l_name"]) - 1), pa.array(of(f["flags"]).astype(np.int32)), pa.array(names[of(f["ref"])], pa.string()), pa.array(of(f["pos"]) + 1), pa.array(of(f["mapq"]).astype(np.int32)),
        cigars, pa.array(names[of(f["mate_ref"])], pa.string()), pa.array(of(f["mate_pos"]) + 1), pa.array(of(f["size"])), star(letters, none), star((marks.astype(np.int64) + 33).astype(np.uint8), none | unknown), mapping, pa.array(ends),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


@dataclass
class Wanted:
    """Which records are kept; regions: of each contig's number the merged starts (from 0) and ends (excluded)."""

    regions: dict[int, tuple[list[int], list[int]]] | None = None
    least_quality: int = 0
    without: int = 0
    tags: bool = True

    def of(self, ref, start, end, mapq, flags) -> np.ndarray:
        ok = (mapq >= self.least_quality) & (flags & self.without == 0)
        if self.regions is not None:
            meets = np.zeros(len(ref), bool)
            for r in np.unique(ref[ok]).tolist():
                if r in self.regions:
                    a, b = (np.array(x, np.int64) for x in self.regions[r])
                    own = np.flatnonzero(ok & (ref == r))
                    k = np.searchsorted(a, end[own], "left") - 1  # the last region that begins before the read ends
                    meets[own] = (k >= 0) & (b[np.maximum(k, 0)] > start[own])
            ok &= meets
        return ok


@dataclass
class Part(InputPartition):
    path: str
    contigs: list[str]
    ranges: list[tuple[int, int | None]]
    wanted: Wanted = field(default_factory=Wanted)

    def __post_init__(self):
        super().__init__(None)


def records(source, part: Part, batch: int = BATCH, count: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """The records that begin within the part's ranges of offsets."""
    for begin, end in part.ranges:
        blocks = Blocks(source, begin >> 16)
        data, starts = b"", []
        spots: list[tuple[int, int]] = []  # where a block begins in data, and in the file
        at, done = begin & 0xFFFF, False

        def more() -> bool:
            nonlocal data
            got = blocks.next()
            if got is None:
                return False
            spots.append((len(data), got[0]))
            data += got[1]
            return True

        more()
        which = 0
        while not done:
            while at + 4 > len(data) and more():
                pass
            if at >= len(data):
                break
            while which + 1 < len(spots) and spots[which + 1][0] <= at:
                which += 1
            if end is not None and (spots[which][1] << 16 | at - spots[which][0]) >= end:
                break
            size = struct.unpack_from("<i", data, at)[0]
            while at + 4 + size > len(data):
                if not more():
                    raise ValueError(f"a record of {part.path} is cut off")
            starts.append(at + 4)
            at += 4 + size
            if len(starts) == batch or len(data) > 64 << 20:
                yield decoded(data, np.array(starts, np.int64), part.contigs, part.wanted)
                cut = spots[which][0]  # the last block stays, so that places within it remain
                while which + 1 < len(spots) and spots[which + 1][0] <= at:
                    which += 1
                    cut = spots[which][0]
                data, at = data[cut:], at - cut
                spots, which, starts = [(a - cut, b) for a, b in spots[which:]], 0, []
        if starts:
            yield decoded(data, np.array(starts, np.int64), part.contigs, part.wanted)
        if count is not None:
            count.append(blocks.read)


# ---------------------------------------------------------------- reading


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.regions = [(str(c), int(a), int(b)) for c, a, b in json.loads(options["regions"])] if options.get("regions") else None
        self.least = int(options.get("leastquality", 0))
        self.without = int(options.get("without", 0))
        self.tags = str(options.get("tags", "true")).lower() == "true"

    def _files(self) -> list[str]:
        from pyarrow.fs import FileSelector, FileType

        store, place = opened(self.path)
        if store.get_file_info(place).type != FileType.Directory:
            return [place]
        return sorted(f.path for f in store.get_file_info(FileSelector(place)) if f.path.endswith(".bam") and not f.base_name.startswith(("_", ".")))

    def plan(self, path: str) -> list[Part]:
        from pyarrow.fs import FileType

        store, _ = opened(self.path)
        with store.open_input_file(path) as source:
            head = head_of(source)
            size = source.size()
        index = None
        for beside in (path + ".bai", path.removesuffix(".bam") + ".bai"):
            if store.get_file_info(beside).type == FileType.File:
                with store.open_input_file(beside) as f:
                    index = Index.parse(f.read())
                break
        names = [n for n, _ in head.contigs]
        number = {n: i for i, n in enumerate(names)}
        regions = None
        if self.regions is not None:
            regions = {}
            for name, spans in _merged_regions(self.regions).items():
                if name in number:
                    regions[number[name]] = ([a for a, _ in spans], [b for _, b in spans])
        wanted = Wanted(regions, self.least, self.without, self.tags)
        if index is None:
            return [Part(path, names, [(head.first, None)], wanted)] if regions is None or regions else []
        begins = index.begins()
        if regions is None:
            chunks: list[tuple[int, int | None]] = [(head.first, size << 16)]
        else:
            chunks = joined([c for ref, (starts, ends) in regions.items() for a, b in zip(starts, ends) for c in index.chunks(ref, a, b)])
        # Large chunks are cut at the last begins of records within ``split`` bytes, or the next ones behind; small chunks share a partition.
        pieces = []
        for a, b in chunks:
            inside = begins[(begins > a) & (begins < b)]
            while (b >> 16) - (a >> 16) > self.split and len(inside):
                k = max(0, int(np.searchsorted(inside, a + (self.split << 16), "right")) - 1)
                cut = int(inside[k])
                pieces.append((a, cut))
                a, inside = cut, inside[k + 1 :]
            pieces.append((a, b))
        out, held, own = [], 0, []
        for a, b in pieces:
            n = (b >> 16) - (a >> 16)
            if own and held + n > self.split:
                out.append(own)
                own, held = [], 0
            own.append((a, b))
            held += n
        return [Part(path, names, x, wanted) for x in [*out, *([own] if own else [])]]

    def partitions(self) -> list[Part]:
        return [p for path in self._files() for p in self.plan(path)] or [Part("", [], [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.ranges:
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as source:
            yield from records(source, partition)


def _merged_regions(regions: list[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """By contig, from 0 and with the end excluded."""
    by: dict[str, list[tuple[int, int]]] = {}
    for name, a, b in regions:
        if b >= a:
            by.setdefault(name, []).append((max(0, a - 1), b))
    return {name: joined(own) for name, own in by.items()}


# ---------------------------------------------------------------- writing


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    indexed: bool


def encoded(row: dict, number: dict[str, int]) -> tuple[bytes, int, int, int]:
    """A record with its size, its contig's number, and its positions from 0, end excluded."""
    ops, along = _operations(row["cigar"]) if row["cigar"] not in (None, "*") else ((), 0)
    pos = (row["position"] or 0) - 1
    end = pos + max(1, along)
    bases = "" if row["bases"] in (None, "*") else row["bases"]
    size = len(bases)
    packed = bytes.fromhex(bases.translate(_HEX) + "0" * (size % 2))
    marks = b"\xff" * size if row["qualities"] in (None, "*") else row["qualities"].encode("latin-1").translate(_LESS)
    extra = b"".join([_tag(k, v) for k, v in sorted(row["tags"])]) if row["tags"] else b""
    if len(ops) > 65_535:
        extra += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = (size << 4 | OPS.index("S"), end - pos << 4 | OPS.index("N"))
    name = (row["name"] or "*").encode() + b"\0"
    ref, mate = number.get(row["chromosome"], -1), number.get(row["mate_chromosome"], -1)
    tail = b"".join([name, struct.pack(f"<{len(ops)}I", *ops), packed, marks, extra])
    head = struct.pack("<iiiBBHHHiiii", 32 + len(tail), ref, pos, len(name), row["mapq"] or 0, _bin(max(pos, 0), max(end, 1)), len(ops), row["flags"] or 0, size, mate, (row["mate_position"] or 0) - 1, row["insert_size"] or 0)
    return head + tail, ref, pos, end


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows as ``encoded`` takes them: whole columns become lists at once, a missing number is 0, tags are pairs."""
    columns = []
    for field_, column in zip(batch.schema, batch.columns):
        if pa.types.is_map(field_.type):
            pairs = list(zip(column.keys.to_numpy(zero_copy_only=False).tolist(), column.items.to_numpy(zero_copy_only=False).tolist()))
            edges = column.offsets.to_numpy(zero_copy_only=False).tolist()
            some = column.is_valid().to_numpy(zero_copy_only=False).tolist()
            columns.append([pairs[a:b] if ok else [] for a, b, ok in zip(edges, edges[1:], some)])
        else:
            whole = column.fill_null(0) if pa.types.is_integer(field_.type) else column
            columns.append(whole.to_numpy(zero_copy_only=False).tolist())
    for values in zip(*columns):
        yield dict(zip(batch.schema.names, values))


class _Codes(dict):
    """Letters to the hexadecimal digits of their codes; unknown ones are N."""

    def __missing__(self, letter: int) -> str:
        found = BASES.find(chr(letter).upper())
        return self.setdefault(letter, f"{found if found >= 0 else 15:x}")


_HEX, _LESS = _Codes(), bytes((i - 33) % 256 for i in range(256))


def _bin(start: int, end: int) -> int:
    """``bin_of`` for one record."""
    first = 4681
    for shift in (14, 17, 20, 23, 26):
        if start >> shift == end - 1 >> shift:
            return first + (start >> shift)
        first = (first - 1) >> 3
    return 0


@functools.lru_cache(4096)
def _operations(cigar: str) -> tuple[tuple[int, ...], int]:
    """The codes of a cigar, and how many positions it covers."""
    out, n, along = [], 0, 0
    for c in cigar:
        if c.isdigit():
            n = n * 10 + int(c)
        else:
            out.append(n << 4 | OPS.index(c))
            along += n if c in ALONG else 0
            n = 0
    return tuple(out), along


@functools.lru_cache(4096)
def _tag(name: str, value: str) -> bytes:
    """A whole number is written as such, all else as text."""
    if value.lstrip("-").isdigit() and -(1 << 31) <= int(value) < 1 << 31 and str(int(value)) == value:
        return name.encode() + b"i" + struct.pack("<i", int(value))
    return name.encode() + b"Z" + value.encode() + b"\0"


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.contigs = [(str(n), int(size)) for n, size in json.loads(options["contigs"])]
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, place = opened(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.run}.bam"
        temporary = f"{place}/_temporary-{self.run}/{uuid.uuid4().hex}"
        store.create_dir(temporary.rpartition("/")[0], recursive=True)
        number = {n: i for i, (n, _) in enumerate(self.contigs)}
        text = "".join([*["@HD\tVN:1.6\tSO:coordinate\n"], *[f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in self.contigs]]).encode()
        head = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.contigs))
        head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in self.contigs)
        places: list[tuple[int, int]] = []  # of each block: where it begins inflated, and in the file
        spans = array("q")  # of each record: contig, start, end, where it begins and ends, inflated
        sizes = {"file": 0, "inflated": 0}
        with store.open_output_stream(temporary, compression=None) as out:

            def put(data: bytes) -> None:
                places.append((sizes["inflated"], sizes["file"]))
                made = block(data)
                out.write(made)
                sizes["file"] += len(made)
                sizes["inflated"] += len(data)

            for k in range(0, len(head), BLOCK):
                put(head[k : k + BLOCK])
            held, at = bytearray(), sizes["inflated"]
            for batch in iterator:
                for row in _rows(batch):
                    record, ref, start, end = encoded(row, number)
                    spans.extend((ref, start, end, at, at + len(record)))
                    at += len(record)
                    held += record
                    while len(held) >= BLOCK:
                        put(bytes(held[:BLOCK]))
                        del held[:BLOCK]
            if held:
                put(bytes(held))
            places.append((sizes["inflated"], sizes["file"]))
            out.write(LAST_BLOCK)
        index = made_index(spans, places, len(self.contigs))
        if index is not None:
            with store.open_output_stream(temporary + ".bai", compression=None) as out:
                out.write(index)
        return Written(temporary, f"{place}/{name}", index is not None)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector

        store, place = opened(self.path)
        if self.overwrite:
            for f in store.get_file_info(FileSelector(place, allow_not_found=True)):
                if f.base_name.startswith("part-"):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.final)
                if m.indexed:
                    store.move(m.temporary + ".bai", m.final + ".bai")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        store, place = opened(self.path)
        if store.get_file_info(f"{place}/_temporary-{self.run}").type == FileType.Directory:
            store.delete_dir(f"{place}/_temporary-{self.run}")


def made_index(spans: array | list[tuple[int, int, int, int, int]], places: list[tuple[int, int]], contigs: int) -> bytes | None:
    """The index of records in file order; none where they are not sorted by contig and position."""
    rows = np.array(spans, np.int64).reshape(-1, 5)
    ref = np.where(rows[:, 0] < 0, contigs, rows[:, 0])
    if len(rows) > 1 and ((ref[1:] < ref[:-1]) | ((ref[1:] == ref[:-1]) & (rows[1:, 1] < rows[:-1, 1]))).any():
        return None
    begin, where = (np.array(x, np.int64) for x in zip(*places))

    def offset(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(begin, x, "right") - 1
        return where[k] << 16 | x - begin[k]

    starts, ends, bins = offset(rows[:, 3]), offset(rows[:, 4]), bin_of(np.maximum(rows[:, 1], 0), np.maximum(rows[:, 2], 1))
    out = [b"BAI\x01", struct.pack("<i", contigs)]
    for r in range(contigs):
        own = np.flatnonzero(ref == r)
        # Neighbours in the file and in a bin are one chunk.
        cut = np.ones(len(own), bool)
        cut[1:] = bins[own[1:]] != bins[own[:-1]]
        head = own[cut]
        tail = np.append(own[1:][cut[1:]], own[-1] + 1)[: len(head)] - 1 if len(own) else own
        chunks: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(head.tolist(), tail.tolist()):
            chunks.setdefault(int(bins[a]), []).append((int(starts[a]), int(ends[b])))
        out.append(struct.pack("<i", len(chunks)))
        for number, some in sorted(chunks.items()):
            out.append(struct.pack("<Ii", number, len(some)) + b"".join(struct.pack("<QQ", *x) for x in some))
        last = int(((rows[own, 2] - 1) >> WINDOW).max(initial=-1))
        least = np.full(last + 1, np.iinfo(np.int64).max, np.int64)
        first_window, last_window = np.maximum(rows[own, 1], 0) >> WINDOW, (rows[own, 2] - 1) >> WINDOW
        n = last_window - first_window + 1
        np.minimum.at(least, np.repeat(first_window, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), np.repeat(starts[own], n))
        # A window without reads has the offset of the next one that has some.
        least = np.minimum.accumulate(least[::-1])[::-1]
        out.append(struct.pack("<i", len(least)) + least.astype("<u8").tobytes())
    out.append(struct.pack("<Q", int((ref == contigs).sum())))
    return b"".join(out)


class BamSource(DataSource):
    """Options: path (a file, or a folder of ``.bam`` files); reading: regions (JSON), split, leastQuality, without (flags), tags; writing: contigs (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def alignments(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, least_quality: int = 0, duplicates: bool = True, supplementary: bool = True, tags: bool = True, split: int = SPLIT) -> DataFrame:
    """Records of binary alignment files, as ``readers.alignments`` gives those of text; a read that meets several regions comes once.

    regions: (chromosome, start, end) from 1 on, both included, which the driver looks up in the index; for a table of regions of any size, join with ``intervals.range_join``.
    """
    ship(spark)
    spark.dataSource.register(BamSource)
    options = {"leastQuality": least_quality, "without": (0 if duplicates else 0x400) | (0 if supplementary else 0x800), "tags": tags, "split": split}
    if regions is not None:
        options["regions"] = json.dumps(regions)
    return spark.read.format("bam").options(**options).load(path)


def written(rows: DataFrame, path: str, contigs: list[tuple[str, int]], partitions: int = 32) -> None:
    """Reads (as the readers give them) as at least ``partitions`` files of binary alignments in the order of contigs and positions, each with an index; those of unknown contigs come last."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(BamSource)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(n) for n, _ in contigs]), F.col("chromosome")), F.lit(0))
    keyed = rows.select(*[F.col(c) for c in NAMES]).withColumn("__rank", F.when(rank == 0, len(contigs) + 1).otherwise(rank))
    ordered = keyed.repartitionByRange(files_for(rows, partitions), "__rank", "position").sortWithinPartitions("__rank", "position").drop("__rank")
    ordered.write.format("bam").mode("append").option("contigs", json.dumps(contigs)).save(path)

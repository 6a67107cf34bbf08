"""Alignment of two tokenizers' tokens over the bytes that both read, with corpus-wide counts of linked ids.

Texts are encoded once; their ids are written to the shared folder, two bytes each where the vocabulary allows it. What follows works on whole Arrow batches of ids: the
tokens of all documents are laid end to end in bytes, documents at their offsets. One bincount for each tokenizer marks where its tokens end;
where both end, groups are cut. Every place where either ends closes one link, as just one token of each covers
the bytes before it; prefix sums of the marks number the tokens, and their differences at the documents' offsets give each document's counts.

Counts of linked ids are summed by task, then by pair. The table of pairs is bounded by the two vocabularies, is written to the shared folder sorted and in files of
``FILE_PAIRS`` rows, and the tasks of the last pass look their pairs up in one file after another.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, opened, stored, table, tokenizer_path, utf8

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
FILE_PAIRS = 1 << 20
#: Characters of texts that are encoded at a time; a longer text alone.
ENCODED = 1 << 20
#: Distinct pairs that a task of the second pass holds before it hands them on.
HELD_PAIRS = 1 << 21
#: What the byte-level pre-tokenizer splits texts by: a fixed value of that kind of tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Vocabulary:
    """The bytes of each token id, end to end; where each begins, with the end as last entry; how many there are."""

    data: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        return cls(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)]))

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.first[ids + 1] - self.first[ids]

    def read(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths(ids)
        return self.data[np.repeat(self.first[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def byte_alphabet() -> dict[str, int]:
    """Which byte each character of byte-level vocabularies stands for: printable ones for themselves, from 256 on the others in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(other)): b for b in range(256)}


class Pair:
    """Two tokenizers: A from a ``tokenizers`` file, B a SentencePiece model.

    Where A is a plain byte-level BPE whose ids stand in the order of its merges, ``tiktoken`` encodes by the same vocabulary, several times as fast; a text that it fails on, and other tokenizers, go to ``tokenizers``.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        known = self.a.get_vocab()
        tokens = [b""] * (max(known.values()) + 1)
        for t, i in known.items():
            tokens[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        self.fast = self._tiktoken(json.loads(self.a.to_str()), tokens)
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_a = Vocabulary.of(tokens)
        self.of_b = Vocabulary.of([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.a_size, self.b_size = len(tokens), len(pieces)

    @staticmethod
    def _tiktoken(told: dict, tokens: list[bytes]):
        split, model = told["pre_tokenizer"] or {}, told["model"]
        if told["normalizer"] is not None or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model["type"] != "BPE":
            return None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [model["vocab"].get(x + y) for x, y in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        ranks = {t: i for i, t in enumerate(tokens[: 256 + len(merges)])}
        return tiktoken.Encoding("pair", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        out = []
        for t in texts:
            try:
                out.append(self.fast.encode_ordinary(t))
            except BaseException as e:  # its panics are no Exceptions: a run of very many spaces overflows its stack
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                out.append(self.a.encode(t, add_special_tokens=False).ids)
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none for empty texts, and where the tokens of either don't give back a space and the text."""
        wanted = [" " + t for t in texts]
        data, at = utf8(pa.array(wanted, pa.large_string()))
        both = self.encode_a(wanted), self.b.encode(texts, num_threads=1) if texts else []
        ok = np.array([bool(t) for t in texts], bool)
        for lists, vocabulary in zip(both, (self.of_a, self.of_b)):
            ok &= faithful(lists, vocabulary, data, at)
        empty = np.zeros(0, np.int64)
        return tuple([np.array(ids, np.int64) if good else empty for ids, good in zip(lists, ok.tolist())] for lists in both)


def faithful(lists: list[list[int]], vocabulary: Vocabulary, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the tokens of each text, whose bytes begin ``at``, are its bytes."""
    count = np.array([len(x) for x in lists], np.int64)
    ids = np.fromiter((i for x in lists for i in x), np.int64, int(count.sum()))
    edge = np.concatenate([[0], np.cumsum(count)])
    total = np.concatenate([[0], np.cumsum(vocabulary.lengths(ids))])
    same = np.diff(total[edge]) == np.diff(at)
    read = vocabulary.read(ids[np.repeat(same, count)])
    wrong = np.concatenate([[0], np.cumsum(read != data[np.repeat(same, np.diff(at))])])
    size = np.concatenate([[0], np.cumsum(np.where(same, np.diff(at), 0))])
    return same & (np.diff(wrong[size]) == 0)


@dataclass
class Laid:
    """A batch of documents laid end to end: of each link its pair of ids; of each document where its links, tokens and groups end (prefix sums); of each token its group."""

    pairs: np.ndarray
    links: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray


def laid(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, offsets: np.ndarray, b_vocabulary: int) -> Laid:
    """Token ids and byte lengths of all documents, whose bytes begin at ``offsets`` (with the end as last entry)."""
    total = int(offsets[-1])
    a_end = np.bincount(np.cumsum(a_sizes), minlength=total + 1).astype(bool)
    b_end = np.bincount(np.cumsum(b_sizes), minlength=total + 1).astype(bool)
    at = np.flatnonzero(a_end | b_end)
    ends_a, ends_b = a_end[at], b_end[at]
    before_a, before_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b  # of the token that covers the byte before
    cut = ends_a & ends_b
    group = np.cumsum(cut) - cut
    edge = np.searchsorted(at, offsets, "right")
    upto = [np.concatenate([[0], np.cumsum(x)])[edge] for x in (ends_a, ends_b, cut)]
    return Laid(a[before_a] * b_vocabulary + b[before_b], edge, *upto, group[ends_a], group[ends_b])


def groups_text(got: Laid, a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of all documents end to end, and where each begins: ids in cells of equal width, of which the used part is kept."""
    groups = int(got.n_groups[-1])
    of_a, of_b = np.bincount(got.a_group, minlength=groups), np.bincount(got.b_group, minlength=groups)
    at_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[got.a_group]
    at_b = np.arange(len(b)) + np.cumsum(of_a)[got.b_group]
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[np.append(got.a_group[1:] != got.a_group[:-1], True)[: len(a)]]] = ord("|")
    mark[at_b[np.append(got.b_group[1:] != got.b_group[:-1], True)[: len(b)]]] = ord(";")
    width = len(str(ids.max(initial=0)))
    digits = ids[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10
    length = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, width))
    cells = np.concatenate([(digits + 48).astype(np.uint8), mark[:, None]], axis=1)
    used = np.arange(width + 1) >= (width - length)[:, None]
    edge = got.n_a + got.n_b
    last = edge[1:][np.diff(edge) > 0] - 1  # a document's last mark is left out
    used[last, -1] = False
    size = np.concatenate([[0], np.cumsum(used.sum(1))])
    return cells[used].tobytes(), size[edge]


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    """The process's own."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = Pair(a_path, b_path)
    return _pairs[a_path, b_path]


def _dtype(size: int):
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(id, a, b) of docs (id, text): the ids of both tokenizers as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        kinds = _dtype(pair.a_size), _dtype(pair.b_size)
        for batch in batches:
            lo, texts = 0, [t or "" for t in batch["text"].to_pylist()]
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= ENCODED):
                    held += len(texts[hi])
                    hi += 1
                columns = [pa.array([x.astype(kind).tobytes() for x in ids], pa.binary()) for ids, kind in zip(pair.encode(texts[lo:hi]), kinds)]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), *columns], ["id", "a", "b"])
                lo = hi

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, a binary, b binary")


def _of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and where each row's begin."""
    data, at = utf8(column.cast(pa.binary()).view(pa.string()))
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), at // kind.itemsize


def _laid_batch(pair: Pair, batch: pa.RecordBatch) -> tuple[Laid, np.ndarray, np.ndarray]:
    a, at = _of(batch["a"], _dtype(pair.a_size))
    b, _ = _of(batch["b"], _dtype(pair.b_size))
    a_sizes = pair.of_a.lengths(a)
    offsets = np.concatenate([[0], np.cumsum(a_sizes)])[at]
    return laid(a, a_sizes, b, pair.of_b.lengths(b), offsets, pair.b_size), a, b


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def link_counts(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): how many links of (a, b) hold a pair of ids; pair is A's id times B's vocabulary, plus B's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        for batch in batches:
            waiting.append(_laid_batch(pair, batch)[0].pairs)
            if sum(map(len, waiting)) >= HELD_PAIRS:
                more, n = np.unique(np.concatenate(waiting), return_counts=True)
                keys, counts = _summed(np.concatenate([keys, more]), np.concatenate([counts, n]))
                waiting = []
                if len(keys) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                    keys, counts = keys[:0], counts[:0]
        more, n = np.unique(np.concatenate([*waiting, keys[:0]]), return_counts=True)
        keys, counts = _summed(np.concatenate([keys, more]), np.concatenate([counts, n]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    return in_batches(tokens).select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


@functools.lru_cache(maxsize=6)
def _file(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    store, place = opened(path)
    with store.open_input_file(place) as f:
        got = pq.ParquetFile(f).read(["pair", "n", "best"])
    return got["pair"].to_numpy(), got["n"].to_numpy(), got["best"].to_numpy(zero_copy_only=False)


def _looked_up(files: list[tuple[int, int, str]], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and best marks of sorted pairs, all of which the files have between them; one file at a time."""
    n, best = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    for least, most, path in files:
        x, y = np.searchsorted(wanted, least), np.searchsorted(wanted, most, "right")
        if x < y:
            keys, counts, marks = _file(path)
            at = np.searchsorted(keys, wanted[x:y])
            n[x:y], best[x:y] = counts[at], marks[at]
    return n, best


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, file_pairs: int = FILE_PAIRS, with_groups: bool = False) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]): a row for each row of docs.

    A encodes a space and the text, B the text, before which it puts a space itself; strings of special tokens are ordinary text. Null and empty texts, and those whose tokens don't give back
    their bytes, have no tokens: zeros and an empty string. A link is a token of each that share bytes; its count is how many links of all rows hold its pair of ids, so repeated rows count each.
    n_best counts links whose count is the highest of their B id, ties included; count_sum sums counts. groups are ids by group, ``a1,a2|b1;a3|b2,b3``. Ids may repeat or be null; an empty table gives no rows;
    other columns are ignored, so names can't clash. A text is held whole by its task. ``file_pairs`` does not change results.
    """
    a_path, b_path = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    tokens = stored(encoded(in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), a_path, b_path), "tokens")
    counts = stored(link_counts(tokens, a_path, b_path), "links")
    size = pair_of(a_path, b_path).b_size
    highest = counts.groupBy((F.col("pair") % size).alias("b")).agg(F.max("n").alias("top"))  # at most a row for each of B's ids
    marked = counts.join(F.broadcast(highest), F.col("pair") % size == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    parts = max(1, -(-counts.count() // file_pairs))
    sorted_pairs = stored(marked.repartitionByRange(parts, "pair").sortWithinPartitions("pair"), "pairs")
    name = F.col("_metadata.file_path")
    files = [(r.least, r.most, r.path) for r in sorted_pairs.groupBy(name.alias("path")).agg(F.min("pair").alias("least"), F.max("pair").alias("most")).collect()]  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
        for batch in batches:
            got, a, b = _laid_batch(pair, batch)
            keys, inverse = np.unique(got.pairs, return_inverse=True)
            n, best = _looked_up(files, keys)
            sums = [np.concatenate([[0], np.cumsum(x[inverse])])[got.links] for x in (best, n)]
            text, edge = groups_text(got, a, b)
            groups = [text[x:y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]
            columns = [np.diff(x) for x in (got.n_a, got.n_b, got.n_groups, got.links, *sums)]
            digest = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            more = [pa.array([g.decode() for g in groups], pa.string())] if with_groups else []
            yield pa.RecordBatch.from_arrays([batch["id"], *[pa.array(x.astype(np.int64)) for x in columns], pa.array(digest, pa.string()), *more], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return in_batches(tokens).select("id", "a", "b").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document, by byte_bpe_50k.json and piece_bpe_32k.model.

    Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have zeros and an empty groups_sha256.
    """
    return aligned(table(spark, sf_dir, "documents"))

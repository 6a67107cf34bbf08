"""WARC archives in Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing: of records with equal payloads of at least ``LEAST`` bytes, the one with the largest id is a response and the others are
revisits that refer to it. Payloads are compared by digest (SHA-256 and length), pre-aggregated before the shuffle; a revisit's payload is not
written. Each task writes archives of its own and returns a manifest row for each, so that files of lost or
repeated attempts are never read. Archives and manifest lie in a folder that driver and executors share.

Reading: a task streams one archive, loads the dictionary from the skippable frame, decodes one frame after another, and validates
version, headers, lengths and digests. A record that fails gives a row with its error. Memory holds one record and one chunk.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, opened, scratch_path, stored, table

LEAST = 1000
#: Magic numbers of the dictionary's frame, of any skippable frame (lowest of 16), and of a Zstandard frame.
DICTIONARY, SKIPPABLE, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
CHUNK = 1 << 20
ROLL = 256 << 20
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 32 << 10
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST) -> DataFrame:
    """(id, url, payload, size, sha1, record_type, refers_to); payload is null for revisits.

    Null texts are empty payloads. Rows that share both the largest id and the payload are all responses; an id that is null is the smallest.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), raw.alias("payload"))
    keyed = keyed.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "key": F.sha2("payload", 256)})
    many = keyed.filter(F.col("size") >= least).groupBy("key").agg(F.max("id").alias("newest"), F.count("*").alias("n")).filter("n > 1 AND newest IS NOT NULL")
    # Joined over another spelling of the key, so that both sides are dealt anew and a large group's rows can be split.
    joined = keyed.withColumn("yek", F.reverse("key")).join(many.select(F.reverse("key").alias("yek"), "newest"), "yek", "left")
    again = F.col("newest").isNotNull() & ~F.col("id").eqNullSafe(F.col("newest"))
    return joined.select("id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "sha1", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("newest")).alias("refers_to"))


def dictionary_of(pages: DataFrame, text_col: str = "html", samples: int = SAMPLES) -> bytes:
    """Trained on the beginnings of at most ``samples`` rows, those with the least hash, equal ones once; only sizes depend on it.

    The hashes alone are ranked first, so that a task sends 8 bytes a candidate to the driver; the texts below the last hash follow.
    """
    own = pages.select(F.substring(F.col(text_col).cast("string"), 1, SAMPLE_BYTES).alias("s")).filter("s IS NOT NULL").withColumn("h", F.xxhash64("s"))
    least = [r.h for r in own.select("h").orderBy("h").limit(samples).collect()]
    texts = [r.s.encode() for r in own.filter(F.col("h") <= least[-1]).select("h", "s").distinct().orderBy("h", "s").limit(samples).collect()] if least else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too few or too small
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record(page: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """A response's bytes, or a revisit's where payload is None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    name = "null" if page is None else str(page)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{URN}{name}>", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', '', url or '')}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Payload-Length: {size}", f"Content-Length: {len(block)}",
    ]
    if payload is None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, dictionary: bytes, roll: int = ROLL) -> DataFrame:
    """Write rows of ``decided`` and return the manifest (path, records, bytes). Archives close when they pass ``roll`` bytes."""
    held = records.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = zstandard.ZstdCompressionDict(held.value)
        packer = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
        lead = zstandard.ZstdCompressor(level=19).compress(held.value)
        lead = struct.pack("<II", DICTIONARY, len(lead)) + lead
        out = path = None
        size = n = 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            columns = [batch[c] for c in ("id", "url", "payload", "size", "sha1", "refers_to")]
            for k in range(batch.num_rows):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    store, place = opened(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(place, compression=None)
                    out.write(lead)
                    size, n = len(lead), 0
                frame = packer.compress(record(*[c[k].as_py() for c in columns]))
                out.write(frame)
                size, n = size + len(frame), n + 1
                if size > roll:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return stored(in_batches(records).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def frames(stream) -> Iterator[bytes | str]:
    """The records' bytes of an archive, one of each frame; a string tells why an archive ends early."""
    rest, ended = b"", False

    def more() -> bool:
        nonlocal rest, ended
        got = b"" if ended else stream.read(CHUNK)
        ended = ended or not got
        rest += got
        return bool(got)

    words = None
    while True:
        while len(rest) < 8 and more():
            pass
        if not rest:
            return
        if len(rest) < 8:
            yield "truncated frame header"
            return
        magic, length = struct.unpack("<II", rest[:8])
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            while len(rest) < 8 + length and more():
                pass
            if len(rest) < 8 + length:
                yield "truncated skippable frame"
                return
            content, rest = rest[8 : 8 + length], rest[8 + length :]
            if magic == DICTIONARY and words is None:
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompress(content)
                words = zstandard.ZstdCompressionDict(content)
            continue
        if magic != FRAME:
            yield "not a Zstandard frame"
            return
        one = zstandard.ZstdDecompressor(dict_data=words).decompressobj() if words else zstandard.ZstdDecompressor().decompressobj()
        parts = []
        try:
            while True:
                parts.append(one.decompress(rest))
                if one.eof:
                    rest = one.unused_data
                    break
                rest = b""
                if not more():
                    yield "truncated frame"
                    return
        except zstandard.ZstdError as e:
            yield f"damaged frame: {e}"
            return
        yield b"".join(parts)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record; ValueError tells what is wrong with it."""
    head, cut, after = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not cut or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise ValueError(f"not a header: {line[:60]!r}")
        if name.strip().lower() in headers:
            raise ValueError(f"header twice: {name}")
        headers[name.strip().lower()] = value.strip()
    if missing := [x for x in NEEDED if x not in headers]:
        raise ValueError(f"missing headers: {', '.join(missing)}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) != len(after) - 4:
        raise ValueError(f"Content-Length {headers['content-length']}, but the block has {len(after) - 4} bytes")
    if after[-4:] != b"\r\n\r\n":
        raise ValueError("no end of record")
    block = after[:-4]
    digest = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    if headers.get("warc-block-digest", digest(block)) != digest(block):
        raise ValueError("block digest differs")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        _, cut, payload = block.partition(b"\r\n\r\n")
        if not cut:
            raise ValueError("no end of HTTP headers")
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest", digest(payload)) != digest(payload):
        raise ValueError("payload digest differs")
    if headers["warc-type"] == "revisit" and not {"warc-payload-digest", "warc-refers-to"} <= set(headers):
        raise ValueError("a revisit without payload digest or WARC-Refers-To")
    return headers, payload


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """(path, frame, record_type, headers map, payload, payload_bytes, payload_sha1, told_sha1, error): a row for each frame.

    payload_bytes and payload_sha1 are of what was decoded, told_sha1 is what the header says, in hex. With an error, the other columns but path and frame are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("path", pa.string()), ("frame", pa.int64()), ("record_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string()), ("told_sha1", pa.string()), ("error", pa.string())]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path in batch["path"].to_pylist():
                    store, place = opened(path)
                    with store.open_input_stream(place, compression=None) as stream:
                        for k, raw in enumerate(frames(stream)):
                            try:
                                if isinstance(raw, str):
                                    raise ValueError(raw)
                                headers, payload = parsed(raw)
                                told = headers.get("warc-payload-digest", "")[5:]
                                told = base64.b32decode(told).hex() if told else None
                            except ValueError as e:
                                yield path, k, None, None, None, None, None, None, str(e)
                                continue
                            yield path, k, headers["warc-type"], list(headers.items()), payload if payloads else None, len(payload), hashlib.sha1(payload).hexdigest(), told, None

        some, size = [], 0
        for r in rows():
            some.append(r)
            size += len(r[4] or b"") + 1000
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    files = max(1, manifest.count())
    schema = "path string, frame long, record_type string, headers map<string,string>, payload binary, payload_bytes long, payload_sha1 string, told_sha1 string, error string"
    return manifest.select("path").repartition(files).mapInArrow(run, schema)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back; null html is an empty payload."""
    pages = table(spark, sf_dir, "pages")
    folder = scratch_path(spark, "warc")
    manifest = write_archives(decided(pages), folder, dictionary_of(pages))
    found = read_archives(spark, manifest, payloads=False)
    head = F.col("headers")
    number = lambda x: F.regexp_extract(x, f"<{URN}(-?[0-9]+)>", 1)
    own = lambda x: F.when(number(x) != "", number(x)).cast("long")
    # A record that can't be read stops the query.
    kind = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")))
    return found.select(
        own(head["warc-record-id"]).alias("page_id"),
        F.when(F.col("record_type") == "revisit", head["x-payload-length"].cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("told_sha1")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        kind.alias("record_type"), own(head["warc-refers-to"]).alias("refers_to"),
    )


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest, sha256(h) AS k FROM p),
m AS (SELECT k, max(page_id) AS newest, count(*) AS n FROM d WHERE payload_bytes >= 1000 GROUP BY k)
SELECT d.page_id, payload_bytes, payload_digest,
       CASE WHEN n > 1 AND d.page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND d.page_id <> newest THEN newest END AS refers_to
FROM d LEFT JOIN m USING (k)
"""

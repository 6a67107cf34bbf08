import hashlib
import io
import struct

import duckdb
import pytest
import zstandard

from helixframe.llm import warc as A


def pages(spark):
    texts = [None, "", "short", "short", "x" * 1000, "x" * 1000, "x" * 1000, "é" * 600, "é" * 600, "WARC/1.1\r\n\r\n" * 200, "y" * 300_000] + [f"<html>{i}</html>" * 90 for i in range(40)]
    return [(i, f"http://a{i}.example/\r\nX: 1", t, 5) for i, t in enumerate(texts)]


def test_query_matches_sql(spark, tmp_path):
    rows = pages(spark)
    spark.createDataFrame(rows, "page_id long, url string, html string, size int").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in A.op4_warc(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(A.OP4_SQL).fetchall())
    assert got[4] == (4, 1000, hashlib.sha1(b"x" * 1000).hexdigest(), "revisit", 6)


def test_round_trip_and_rolling(spark, tmp_path):
    rows = pages(spark) + [(None, None, "z" * 2000, 1), (7, "u", "é" * 600, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, size int").coalesce(2)
    manifest = A.write_archives(A.decided(table), f"file://{tmp_path}/out", A.dictionary_of(table), roll=1500)
    listed = manifest.collect()
    assert len(listed) > 3 and sum(r.records for r in listed) == len(rows)
    found = A.read_archives(spark, manifest).collect()
    assert len(found) == len(rows) and all(r.error is None for r in found)
    by = {}
    for r in found:
        by.setdefault(r.headers["warc-record-id"], []).append(r)
    assert by["<urn:page:9>"][0].payload == rows[9][2].encode() and by["<urn:page:null>"][0].payload == b"z" * 2000
    assert sorted(r.record_type for r in by["<urn:page:7>"]) == ["revisit", "revisit"]
    first = (tmp_path / "out" / listed[0].path.rsplit("/", 1)[1]).read_bytes()
    assert struct.unpack("<I", first[:4])[0] == A.DICTIONARY


def test_damage_is_told():
    words = b"some raw content to compress with " * 4
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    lead = struct.pack("<II", A.DICTIONARY, len(words)) + words
    good = A.record(3, "http://x", b"payload " * 50, 400, hashlib.sha1(b"payload " * 50).hexdigest(), None)
    whole = lead + packer.compress(good) + struct.pack("<II", A.SKIPPABLE + 1, 3) + b"abc" + packer.compress(good)
    assert list(A.frames(io.BytesIO(whole))) == [good, good]
    assert A.parsed(good)[1] == b"payload " * 50
    for cut in range(1, len(whole)):
        out = list(A.frames(io.BytesIO(whole[:cut])))
        assert all(x == good for x in out[:-1]) and (not out or out[-1] == good or isinstance(out[-1], str))
    for bad in (good[:-1], good[:-4], b"X" + good, good.replace(b"WARC-Date", b"WARC-Tate"), good.replace(b"payload payload", b"payload Payload"), good.replace(b"Content-Type: app", b"\r\nContent-Type: app", 1), b""):
        with pytest.raises(ValueError):
            A.parsed(bad)


def test_empty_table(spark, tmp_path):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = A.write_archives(A.decided(table), f"file://{tmp_path}/none", A.dictionary_of(table))
    assert A.read_archives(spark, manifest).count() == 0

"""Binary alignments: written and read again, by regions, over block borders, with blocks counted."""

import json
import random

import numpy as np
import pytest

from helixframe.sources import bam as B

CONTIGS = [("c1", 5_000_000), ("c2", 90_000), ("c3", 40_000)]


def generated(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        name, size = r.choice(CONTIGS)
        length = r.choice([30, 100, 151])
        position = r.randrange(1, size - 2000)
        kind = r.random()
        cigar = f"{length}M" if kind < 0.5 else f"5S{length - 12}M3I4M" if kind < 0.7 else f"10M{r.randrange(1, 900)}N{length - 10}M" if kind < 0.9 else f"2H{length}M700D"
        if cigar.endswith("D"):
            cigar += "0M"
        tags = {"NM": str(r.randrange(9)), "RG": f"g{i % 3}"} if i % 4 else {}
        rows.append((f"r{i}", r.randrange(4096), name, position, r.randrange(61), cigar, r.choice(["c1", "*"]), r.randrange(1, 1000), r.randrange(-500, 500), "".join(r.choice("ACGTN") for _ in range(length)), "".join(chr(33 + r.randrange(60)) for _ in range(length)) if i % 7 else "*", tags, None))
    rows.append(("unplaced", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "III", {}, None))
    rows.append(("nobases", 0, "c2", 7, 3, "10M", "*", 0, 0, "*", "*", {}, None))
    return rows


def end_of(row):
    n, out = "", 0
    for c in row[5]:
        if c.isdigit():
            n += c
        elif c != "*":
            out += int(n) if c in "MDN=X" else 0
            n = ""
    return row[3] + out - 1


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    rows = generated(20_000)
    path = f"{tmp_path_factory.mktemp('bam')}/reads"
    B.written(spark.createDataFrame(rows, B.SCHEMA), path, CONTIGS, 3)
    return [(*r[:-1], end_of(r)) for r in rows], path


def plain(rows):
    return sorted((*tuple(r)[:-2], tuple(sorted(r[-2].items())), r[-1]) for r in rows)


@pytest.mark.parametrize("split", [B.SPLIT, 60_000])
def test_round_trip(spark, files, split):
    rows, path = files
    got = B.alignments(spark, path, split=split)
    if split == 60_000:
        assert got.rdd.getNumPartitions() > 20
    assert plain(got.collect()) == plain(rows)


@pytest.mark.parametrize("regions", [[("c1", 1, 1)], [("c1", 1_000_000, 1_020_000), ("c1", 1_015_000, 1_030_000), ("c3", 1, 40_000)], [("c2", 80_000, 90_000)], [("none", 1, 9)], [("c1", 4_999_999, 5_000_000)], []])
def test_regions(spark, files, regions):
    rows, path = files
    got = B.alignments(spark, path, regions, least_quality=10, duplicates=False, supplementary=False, split=50_000)
    want = [r for r in rows if r[4] >= 10 and not r[1] & 0xC00 and any(r[2] == c and r[3] <= b and max(r[12], r[3]) >= a for c, a, b in regions)]
    assert plain(got.collect()) == plain(want)


def test_a_region_scan_touches_only_blocks_of_its_chunks(files):
    _, path = files
    whole = B.Reader({"path": path})
    reader = B.Reader({"path": path, "regions": json.dumps([("c1", 2_000_000, 2_010_000)])})
    store, _ = B.opened(path)

    def read(parts):
        count = []
        for p in parts:
            with store.open_input_file(p.path) as f:
                list(B.records(f, p, count=count))
        return sum(count)

    blocks, every = read(reader.partitions()), read(whole.partitions())
    assert 0 < blocks < every / 5
    # A chunk is no more than the blocks between its offsets, and the one in which its last record ends.
    for p in reader.partitions():
        index = B.Index.parse(store.open_input_file(p.path + ".bai").read())
        places = set()
        with store.open_input_file(p.path) as f:
            b = B.Blocks(f)
            while got := b.next():
                places.add(got[0])
        named = {x for a, e in B.joined(index.chunks(0, 1_999_999, 2_010_000)) for x in places if a >> 16 <= x <= e >> 16}
        count = []
        with store.open_input_file(p.path) as f:
            list(B.records(f, p, count=count))
        assert sum(count) <= len(named) + len(p.ranges)


def test_small_batches_and_records_over_block_borders(files):
    rows, path = files
    store, _ = B.opened(path)
    names = []
    for p in B.Reader({"path": path}).partitions():
        with store.open_input_file(p.path) as f:
            names += [x for b in B.records(f, p, batch=7) for x in b["name"].to_pylist()]
    assert sorted(names) == sorted(r[0] for r in rows)


def test_without_index_and_damage(spark, tmp_path, files):
    import shutil

    rows, path = files
    reader = B.Reader({"path": path})
    one = reader._files()[0]
    alone = f"{tmp_path}/alone.bam"
    shutil.copy(one, alone)
    inside = B.alignments(spark, one).count()
    assert B.alignments(spark, alone).count() == inside > 0
    assert plain(B.alignments(spark, alone, [("c1", 1, 300_000)]).collect()) == plain(B.alignments(spark, one, [("c1", 1, 300_000)]).collect())
    raw = bytearray(open(one, "rb").read())
    raw[len(raw) // 2] ^= 255
    open(f"{tmp_path}/bad.bam", "wb").write(raw)
    with pytest.raises(Exception, match="block|damaged|gzip|decompress|cut off"):
        B.alignments(spark, f"{tmp_path}/bad.bam").count()


def test_long_cigars_arrays_and_bins(spark, tmp_path):
    cigar = "1M1I" * 40_000
    rows = [("long", 0, "c1", 100, 9, cigar, "*", 0, 0, "A" * 80_000, "*", {"XB": "text"}, None)]
    B.written(spark.createDataFrame(rows, B.SCHEMA), f"{tmp_path}/x", CONTIGS, 1)
    got = B.alignments(spark, f"{tmp_path}/x").collect()
    assert got[0].cigar == cigar and got[0].end == 100 + 40_000 - 1 and dict(got[0].tags) == {"XB": "text"}
    assert B.tags_of(b"ABBs\x02\0\0\0\x01\0\xff\xffXFf\0\0\x80?XAAq") == {"AB": "s,1,-1", "XF": "1", "XA": "q"}
    r = random.Random(3)
    for _ in range(200):
        a = r.randrange(1 << 28)
        b = a + r.choice([1, 100, 20_000, 3_000_000])
        assert int(B.bin_of(np.array([a]), np.array([b]))[0]) in B.bins_over(r.randrange(a, b), b)


def test_overwrite_and_empty(spark, tmp_path, files):
    rows, _ = files
    path = f"{tmp_path}/x"
    frame = spark.createDataFrame(generated(50), B.SCHEMA)
    B.written(frame, path, CONTIGS, 2)
    options = {"contigs": json.dumps(CONTIGS)}
    frame.limit(5).coalesce(1).write.format("bam").mode("overwrite").options(**options).save(path)
    assert B.alignments(spark, path).count() == 5
    frame.limit(0).coalesce(1).write.format("bam").mode("overwrite").options(**options).save(path)
    assert B.alignments(spark, path).count() == 0 and B.alignments(spark, path, [("c1", 1, 10)]).count() == 0


def test_files_grow_in_number_and_not_in_rows(spark, files, monkeypatch):
    import glob

    from helixframe.sources import readers, writers

    rows, path = files
    monkeypatch.setattr(writers, "FILE_ROWS", 2_000)
    found = B.alignments(spark, path)
    B.written(found, path + "-b", CONTIGS, 3)
    writers.alignments(found, path + "-s", 3)
    assert len(glob.glob(f"{path}-b/*.bam")) == len(glob.glob(f"{path}-s/part-*")) == 11
    assert plain(B.alignments(spark, path + "-b").collect()) == plain(rows)
    assert readers.alignments(spark, path + "-s").count() == len(rows)


def test_encoded_fields_of_rare_rows():
    """Lower-case and unknown bases, nulls, negative and huge tags, bins of all sizes, as many operations as fit no field."""
    import pyarrow as pa

    number = {"c1": 0}
    kinds = pa.schema([("name", pa.string()), ("flags", pa.int32()), ("chromosome", pa.string()), ("position", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_chromosome", pa.string()), ("mate_position", pa.int64()), ("insert_size", pa.int64()), ("bases", pa.string()), ("qualities", pa.string()), ("tags", pa.map_(pa.string(), pa.string())), ("end", pa.int64())])
    values = [
        ("a", 1, "c1", 5, 9, "3M", "*", 7, -4, "acx", "!~I", [("XA", "-7"), ("AB", "99999999999"), ("ZZ", "")], 7),
        (None, None, None, None, None, None, None, None, None, None, None, None, None),
        ("long", 0, "c1", 2, 0, "1M1D" * 40_000, "c1", 2, 0, "A" * 40_000, "*", [], None),
    ]
    batch = pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], f.type) for i, f in enumerate(kinds)], schema=kinds)
    for part in (batch, batch.slice(1), batch.slice(0, 1), batch.slice(2)):
        for row, plain_row in zip(B._rows(part), part.to_pylist()):
            assert row["tags"] == (plain_row["tags"] or [])
    data, starts = b"", []
    for row in B._rows(batch):
        starts.append(len(data) + 4)
        data += B.encoded(row, number)[0]
    got = B.decoded(data, np.array(starts, np.int64), ["c1"], B.Wanted()).to_pylist()
    assert (got[0]["bases"], got[0]["qualities"], dict(got[0]["tags"])) == ("ACN", "!~I", {"XA": "-7", "AB": "99999999999", "ZZ": ""})
    assert (got[1]["name"], got[1]["chromosome"], got[1]["position"], got[1]["bases"], got[1]["tags"]) == ("*", "*", 0, "*", [])
    assert (got[2]["cigar"], got[2]["end"], got[2]["tags"]) == ("1M1D" * 40_000, 80_001, [])
    r = random.Random(2)
    for _ in range(2000):
        start = r.randrange(1 << 29)
        end = min(1 << 29, start + 1 + r.randrange(1 << r.randrange(1, 29)))
        assert B._bin(start, end) == B.bin_of(np.array([start]), np.array([end]))[0]

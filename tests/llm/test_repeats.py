"""Removal of long repeats: run-length index, stretches and the whole operator against listing every string."""

import hashlib
import random

import numpy as np
import pytest

from helixframe.llm import repeats as R


def brute(texts, span=R.SPAN):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for x in raw:
        for i in range(len(x) - span + 1):
            seen[x[i : i + span]] = seen.get(x[i : i + span], 0) + 1
    out = []
    for x in raw:
        inside = np.zeros(len(x), bool)
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                inside[i : i + span] = True
        kept = bytes(b for b, gone in zip(x, inside) if not gone)
        out.append((len(x), int(inside.sum()), len(R.runs_of(inside)[0]), hashlib.sha256(kept).hexdigest()))
    return out


def test_matching_statistics_cover_what_occurs_twice():
    r = random.Random(1)
    for _ in range(60):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 60))) for _ in range(r.randrange(1, 6))]
        texts += [texts[0]] * r.randrange(2)
        span = r.randrange(2, 9)
        want = []
        for x in texts:
            inside = np.zeros(len(x), bool)
            for i in range(len(x) - span + 1):
                if sum(y[j : j + span] == x[i : i + span] for y in texts for j in range(len(y) - span + 1)) > 1:
                    inside[i : i + span] = True
            want.append(inside)
        for (a, b), inside in zip(R.marked(texts, span), want):
            got = np.zeros(len(inside), bool)
            for x, y in zip(a, b):
                got[x:y] = True
            assert (got == inside).all()


def test_runs_are_few_in_repetitive_texts():
    r = random.Random(2)
    one = bytes(r.choice(b"acgt") for _ in range(2000))
    texts = [one[:k] + b"x" + one[k + 1 :] for k in range(100, 1900, 36)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    heads, _, _ = R.run_samples(data, np.cumsum([0, *map(len, texts)]))
    assert len(heads) < len(data) / 10


@pytest.mark.parametrize("piece", [1 << 17, 600])
def test_stretches_hold_every_string_once(monkeypatch, piece):
    monkeypatch.setattr(R, "PIECE", piece)
    r = random.Random(3)
    texts = ["".join(r.choice("abcd") for _ in range(n)).encode() for n in (0, 5, 30, 31, 900, 4000)] + [b"x" * 3000, b"xyz" * 700]
    data = np.frombuffer(b"".join(texts), np.uint8)
    row, mini, whole, start, length, reach, times = R.stretches(data, np.cumsum([0, *map(len, texts)]), 30, 9)
    seen = {}
    for k in range(len(row)):
        step = (reach[k] - start[k] - length[k]) // max(1, times[k] - 1)
        for t in range(times[k]):
            a = start[k] + t * step
            for i in range(a, a + length[k] - 29):
                assert (row[k], i) not in seen
                seen[row[k], i] = mini[k]
    assert len(seen) == sum(max(0, len(t) - 29) for t in texts)
    owners = {}
    for (k, i), m in seen.items():
        assert owners.setdefault(texts[k][i : i + 30], m) == m


def corpus(r, n):
    words = ["".join(r.choice("abcdefé") for _ in range(r.randrange(1, 9))) for _ in range(400)]
    passages = [" ".join(r.choices(words, k=r.randrange(10, 60))) for _ in range(4)]
    out = [None, "", "short", "z" * 5000, "ab" * 900, "z" * 150]
    for _ in range(n):
        t = " ".join(r.choices(words, k=r.randrange(1, 200)))
        if r.random() < 0.5:
            cut = r.randrange(len(t))
            t = t[:cut] + r.choice(passages) + t[cut:]
        out.append(t)
    out += r.choices(out, k=n // 4)
    for t in r.choices([x for x in out if x and len(x) > 50], k=n // 3):  # near copies
        k = r.randrange(len(t))
        out.append(t[:k] + "#" + t[k + 1 :])
    return out


@pytest.mark.parametrize(("span", "hot"), [(200, R.HOT), (200, 2), (70, R.HOT), (64, 3)])
def test_operator_against_listing_every_string(spark, span, hot):
    texts = corpus(random.Random(span + hot), 120)
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(5)
    got = R.without_repeats(docs.withColumn("part", docs["row"]), id_col="row", span=span, hot=hot).collect()
    want = brute(texts, span)
    assert len(got) == len(texts)
    for g in got:
        raw = (texts[g.row] or "").encode()
        assert sum(b - a for a, b in g.removed) == g.n_removed
        left, at = b"", 0
        for a, b in g.removed:
            left, at = left + raw[at:a], b
        assert left + raw[at:] == bytes(g.kept)
        assert (g.n_bytes, g.n_removed, len(g.removed), hashlib.sha256(g.kept).hexdigest()) == want[g.row]


def test_empty_table_and_query(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.without_repeats(docs).count() == 0
    texts = corpus(random.Random(9), 40)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in R.op13_repeats(spark, str(tmp_path)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)

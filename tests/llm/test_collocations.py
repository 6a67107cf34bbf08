"""Collocations against plain counting of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixframe.llm import collocations as C

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, top, longest=5, share=100):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            for s in range(2, len(p)):
                for b in range(len(p) - s + 1):
                    q = p[b : b + s]
                    if q in candidates and 100 * a >= share * candidates[q]:
                        gone.add(q)
        own = []
        for p, a in candidates.items():
            if p in gone:
                continue
            score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["the", "The", "of", "é", "Éa", "a", "b", "c", "dd", "x-y", "(q)", "ñ"]
    rows = [(None, None), ("en", ""), ("en", " \t "), ("en", "a.b,c;d"), ("und", "the of"), ("fr", "one " * 3000)]
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!", "\r\n"]) for _ in range(r.randrange(60)))
        if r.random() < 0.5:
            text += " New York  city\tHall of fame "
        rows.append((r.choice(["en", "en", "fr", None]), text))
    return rows + r.choices(rows, k=n // 5)


@pytest.mark.parametrize(("least", "top", "shard", "share", "longest"), [(5, 2000, C.SHARD, 100, 5), (20, 7, 300, 100, 5), (2, 50, 2000, 60, 4), (3, 10, 900, 100, 2)])
def test_against_plain_counting(spark, least, top, shard, share, longest):
    rows = corpus(150, least)
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], "lang string, text string, n int").repartition(3)
    got = C.collocations(docs, least=least, top=top, shard=shard, share=share, longest=longest).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, top, longest, share)


def test_shared_words_and_intervals():
    r = random.Random(5)
    for _ in range(50):
        segments = [[r.randrange(3) for _ in range(r.randrange(1, 12))] for _ in range(r.randrange(1, 8))]
        ids = np.array([w for s in segments for w in s])
        joined = np.array([i < len(s) - 1 for s in segments for i in range(len(s))])
        left = C.lefts(joined)
        order, shared = C.suffix_array(ids, left, 5)
        for k in range(1, 6):
            want = Counter(tuple(s[i : i + k]) for s in segments for i in range(len(s) - k + 1))
            at, n = C.intervals(order, shared, left, k)
            assert {tuple(ids[i : i + k].tolist()): c for i, c in zip(at, n.tolist())} == want and len(at) == len(want)


def test_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(4_000_000_007, 9_000_000_011, 5_000_000_029, 4_000_000_009)], "a long, total long, l long, r long")
    w = "decimal(19,0)"
    got = big.selectExpr(f"CAST(1000 * a AS {w}) * CAST(total AS {w}) div (CAST(l AS {w}) * CAST(r AS {w})) AS s").first().s
    assert got == 1000 * 4_000_000_007 * 9_000_000_011 // (5_000_000_029 * 4_000_000_009)


def test_empty_table_and_query(spark, tmp_path):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    rows = corpus(400, 8)
    spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = C.op11_collocations(spark, str(tmp_path)).collect()
    assert got and sorted(map(tuple, got)) == brute(rows, 100, 2000)

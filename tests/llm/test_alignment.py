"""Alignment of two tokenizers against whole-text encoding and all pairs of overlapping tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import alignment as A
from helixframe.llm.common import tokenizer_path

TEXTS = [
    None, "", " ", "\n", "  two  spaces ", "a\nb\n\nc", "tab\tand wide　space", "mark ▁ here", "▁", "<|endoftext|> and <s> </s> <unk>", "don't we'll 123 4,567.89!?",
    "naïve café — “quoted” … ﬁ é", "日本語のテキスト と 漢字", "emoji 👩‍👩‍👧 x", "\x00nul \x00", "x" * 5000, "line one.\nLine two.\n", " lead", "trail ", "a \nb", "a\n b", "﻿bom \u0085next line", "aé bà c  d", "\x1cfs \x1c x",
]


def whole(texts):
    """Of each text its tokens of both kinds as (id, bytes), or none; from encoding whole texts."""
    pair = A.Pair(tokenizer_path(A.A_FILE), tokenizer_path(A.B_FILE))
    out = []
    for t in texts:
        if not t:
            out.append(([], []))
            continue
        bytes_of = lambda v, i: v.data[v.first[i] : v.first[i + 1]].tobytes()
        a = [(i, bytes_of(pair.of_a, i)) for i in pair.a.encode(" " + t, add_special_tokens=False).ids]
        b = [(i, bytes_of(pair.of_b, i)) for i in pair.b.encode(t)]
        raw = (" " + t).encode()
        good = b"".join(x for _, x in a) == raw == b"".join(x for _, x in b)
        out.append((a, b) if good else ([], []))
    return out


def brute(texts):
    tokens = whole(texts)
    links, groups = [], []
    for a, b in tokens:
        spans = [[], []]
        for to, own in zip(spans, (a, b)):
            at = 0
            for i, x in own:
                to.append((i, at, at + len(x)))
                at += len(x)
        own = []
        for i, x, y in spans[0]:
            own += [(i, j) for j, p, q in spans[1] if p < y and x < q]
        links.append(own)
        cuts = sorted({y for *_, y in spans[0]} & {y for *_, y in spans[1]})
        lo, text = 0, []
        for c in cuts:
            text.append("|".join(",".join(str(i) for i, x, y in s if lo <= x and y <= c) for s in spans))
            lo = c
        groups.append(";".join(text))
    counts = Counter(p for own in links for p in own)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [
        (len(a), len(b), g.count("|"), len(own), sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for (a, b), own, g in zip(tokens, links, groups)
    ]


def random_texts(n, seed=3):
    r = random.Random(seed)
    words = ["the", "of", "naïve", "x1", "Wort,", "l'été", "▁", "…", "don't", "日本", "  ", "a\nb", "\t", "1234", "UPPER", "zzz.", "-", " "]
    return [r.choice(["", " ", "\n"]).join([""]) + r.choice([" ", " ", "\n"]).join(r.choices(words, k=r.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("file_pairs", [A.FILE_PAIRS, 40])
def test_against_whole_texts_and_all_pairs(spark, file_pairs):
    texts = TEXTS + random_texts(120) + TEXTS[:9]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, id int").repartition(4)
    rows = A.aligned(docs, file_pairs=file_pairs, with_groups=True).collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in rows}
    want = brute(texts)
    assert len(rows) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (texts[i], got[i][-1], w[-1])


def test_both_libraries_give_the_same_ids():
    pair = A.Pair(tokenizer_path(A.A_FILE), tokenizer_path(A.B_FILE))
    assert pair.fast is not None
    texts = [" " + (t or "") for t in TEXTS + random_texts(200, 4)] + [" " * 5000 + "x", "ab" * 20_000, "1" * 10_000]
    fast = pair.encode_a(texts)
    pair.fast = None
    assert fast == pair.encode_a(texts)


def test_a_text_that_the_faster_library_fails_on(monkeypatch):
    pair = A.Pair(tokenizer_path(A.A_FILE), tokenizer_path(A.B_FILE))
    want = pair.encode(["some text", "more"])

    class Panic(BaseException):
        pass

    class Fails:
        def encode_ordinary(self, text):
            raise Panic

    monkeypatch.setattr(pair, "fast", Fails())
    assert [[x.tolist() for x in own] for own in pair.encode(["some text", "more"])] == [[x.tolist() for x in own] for own in want]


def test_laid_by_hand():
    got = A.laid(np.array([7, 8, 9]), np.array([2, 2, 1]), np.array([1, 2]), np.array([4, 1]), np.array([0, 4, 4, 5]), 10)
    assert got.pairs.tolist() == [71, 81, 92] and np.diff(got.links).tolist() == [2, 0, 1] and np.diff(got.n_groups).tolist() == [1, 0, 1]


def test_empty_table_and_query(spark, tmp_path):
    assert A.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: tuple(r)[1:] for r in A.op12_alignment(spark, str(tmp_path)).collect()}
    assert [rows[i] for i in range(len(TEXTS))] == [w[:-1] for w in brute(TEXTS)]

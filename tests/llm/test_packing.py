import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import packing as P
from helixframe.llm.common import tokenizer_path

E = P.Encoder(tokenizer_path())


def ids(text):
    return E.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("ab'sdRe1, .\n\t\r !é日  \x1c\x85\x0b\0<|>\U0001f600²ʼ") + ["e\u0301", "wörd,", "!!", "<|endoftext|>", "don't", "  "]), max_size=60).map("".join))
def test_cut_texts_give_the_same_ids(text):
    assert np.frombuffer(E.encode([text])[0], "<u4").tolist() == ids(text)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(2049, np.int64)
    lengths = rng.integers(1, 2049, [5, 300, 20_000, 200_000][seed])
    np.add.at(counts, lengths, 1)
    plan = P.plan(counts)
    fill = defaultdict(list)
    for v in np.flatnonzero(counts):
        seq, at = plan.place(np.full(counts[v], v), np.arange(counts[v]))
        if seed < 3:
            for s, o in zip(seq.tolist(), at.tolist()):
                fill[s].append((o, int(v)))
    least = -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert plan.sequences <= max(least + 2, least * [1.6, 1.06, 1.01, 1.005][seed])
    if seed < 3:
        assert sorted(fill) == list(range(plan.sequences))
        for own in fill.values():
            end = 0
            for o, v in sorted(own):
                assert o == end
                end += v
            assert end <= 2048


def test_the_fit_is_a_least_squares_solution_and_places_most_pieces():
    rng = np.random.default_rng(3)
    counts = np.zeros(65, np.int64)
    np.add.at(counts, rng.integers(1, 65, 4000), 1)
    found = P.patterns(counts, 64)
    x = P.fit(found, counts, rounds=20_000, settled=0)
    a = np.zeros((65, len(found)))
    for k, own in enumerate(found):
        for v in own[own > 0]:
            a[v, k] += 1
    want = counts.astype(float)
    want[0] = 0
    # The conditions of a non-negative least-squares solution: no coordinate can fall below, and used ones are flat.
    slope = a.T @ (a @ x - want)
    assert slope.min() > -0.05 * want.max() and abs(slope * x).max() < 0.05 * want.max() * x.max()
    assert np.linalg.norm(a @ x - want) < 0.35 * np.linalg.norm(want)
    whole = np.zeros(2049, np.int64)
    np.add.at(whole, np.clip(rng.lognormal(6, 1, 50_000), 1, 2048).astype(int), 1)
    plan = P.plan(whole)
    # The fit places a third of the pieces, and no packing could have one sequence less than nearly these.
    assert plan.fitted > 0.3 * whole[:2048].sum()
    assert plan.sequences <= -(-int((whole * np.arange(2049)).sum()) // 2048) + 3


def test_other_tokenizers_encode_whole_texts():
    coder = P.Encoder(tokenizer_path("word_bpe_49k.json"))
    texts = ["One two,  three", "", "a\nb"]
    assert not coder.cuts and coder.encode(texts) == coder.plain(texts)


def test_whole_operator(spark):
    rng = random.Random(4)
    texts = [None, "", "one", "a " * 3000, "x" * 4095, "two  spaces\n\nlines"] + [" ".join(rng.choice(["foo", "bar,", "é"]) for _ in range(rng.randrange(900))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, length int").repartition(5)
    rows = P.packed(docs, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        want = ids(t or "") + [0]
        own = sorted(by_doc[i], key=lambda r: r.start)
        if i == 3:
            own = own[::2]
            assert len(by_doc[3]) == 2 * len(own)
        assert [x for r in own for x in r.ids] == want
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 2048 for r in own[1:])
    for own in by_seq.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 2048


def test_empty_table(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import hashlib
import random
import re

import pyarrow as pa

from helixframe.llm import decontaminate as D
from helixframe.llm import words as W
from helixframe.llm.common import utf8


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, bench):
    w, hit, found, longest = words(text), set(), set(), (0, 0, None)
    for name, t in bench:
        b = words(t)
        k = min(10, len(b))
        for i in range(len(b) - k + 1 if b else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == b[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(name))
                    n = k
                    while i + n < len(b) and j + n < len(w) and b[i + n] == w[j + n]:
                        n += 1
                    longest = min(longest, (-n, j, str(name))) if longest[0] else (-n, j, str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), -longest[0], longest[1], longest[2]


def cases():
    rng = random.Random(5)
    vocab = ["a", "b", "É", "the", "x1", "Foo", "über"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, say(rng.choice([0, 1, 3, 9, 10, 11, 40]) + 4 * (i % 3))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "zz yy xx")]
    docs = [None, "", "...", "zz, YY! xx", "zz yy xx zz yy xx"] + [say(rng.randrange(60)) + (" " + (rng.choice(bench)[1] or "") if i % 2 else "") for i in range(25)]
    long = bench[3][1] + " " + say(3000) + " " + max((t for _, t in bench if t), key=len) + " END"
    return [*docs, long, long], bench


def test_matches_brute_force(spark):
    docs, bench = cases()
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = {i: brute(t, bench) for i, t in enumerate(docs)}
    for most in (10**6, 20):  # one block, then several
        rows = D.overlaps(table, items, item_words=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.longest_match, r.longest_at, r.longest_item) for r in rows} == want
    clean = D.decontaminated(table, items)
    assert clean.columns == table.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[4]}


def test_occurrences_in_pieces_give_the_same():
    docs, bench = cases()
    data, at = utf8(pa.array(docs))
    known = D.items([(str(i), t or "") for i, t in bench])
    low = W.LOWER[data]
    got = W.split(low, at, W.ALNUM)
    shard = D.Shard.of(W.span_hashes(low, got.starts, got.ends), got.row, D.WINDOW)
    hits = D.search(shard, known)
    assert len(hits.at) > 20 and (hits.hi - hits.lo).max() > 3
    for most in (1, 2, 7):
        assert D.found_in(shard, known, hits, len(docs), most) == D.found_in(shard, known, hits, len(docs))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.overlaps(docs, items).count() == 0
    assert not D.overlaps(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items).first().contaminated


def test_ties_take_the_first_place_and_the_least_item(spark):
    a, b = " ".join(f"a{i}" for i in range(12)), " ".join(f"b{i}" for i in range(12))
    docs = spark.createDataFrame([(0, f"{a} x y {b} {a}", "t"), (1, f"{b} {a}", "t")], "doc_id long, text string, __text string")
    items = spark.createDataFrame([(9, b), (2, b), (1, a), (10, a), (None, a)], "item_id long, text string")
    for most in (10**6, 12):
        rows = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item, r.n_items) for r in D.overlaps(docs, items, item_words=most).collect()}
        assert rows == {0: (12, 0, "", 5), 1: (12, 0, "2", 5)}


def test_a_long_item_copied_whole_and_boilerplate_of_many_items(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    shared = " ".join(f"s{i}" for i in range(30))
    items = spark.createDataFrame([(0, long)] + [(i, f"{shared} own{i}") for i in range(1, 300)], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"before {long} behind"), (1, f"{shared} x " * 200), (2, "clean words only")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.longest_match, r.longest_at) for r in D.overlaps(docs, items).collect()}
    assert got == {0: (20_000, 1, 20_000, 1), 1: (6000, 299, 30, 0), 2: (0, 0, 0, 0)}

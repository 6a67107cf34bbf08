import re

import xxhash

from helixframe.llm import simhash as S


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{id: least id reachable}; fps: (id, fingerprint) pairs."""
    names = list(fps)
    root = {i: i for i, _ in names}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in names:
        for j, b in names:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in names}


TEXTS = [None, "", "One", "one  TWO", "One two three", "one two\tthree", "É à ü ßx  y", "a b c d e f g " * 40, "x\n" * 9] + [f"the quick brown fox {i} jumps over lazy dogs again and again {i % 3}" for i in range(30)]


def test_fingerprints_and_components_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, fp int, component_id int")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(docs).collect()}
    want = {i: brute_fp(t) for i, t in enumerate(TEXTS * 2)}
    assert {i: x[0] for i, x in got.items()} == want
    assert {i: x[1] for i, x in got.items()} == brute_components(want.items())


def test_hot_keys_lose_no_link(spark):
    import random

    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):
        x = base
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 6])):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    nodes = spark.createDataFrame(rows, "fp long")
    want = brute_components([(x, x & (2**64 - 1)) for (x,) in rows])
    for hot in (3, 10_000):
        got = {r.node: r.root for r in S.components(S.links(nodes, hot)).collect()}
        groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
        assert groups({x: got.get(x, x) for (x,) in rows}) == groups(want)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_component_stays(spark):
    rows = [(i, t, i % 3) for i, t in enumerate(TEXTS * 2)] + [(3, TEXTS[3], 0), (None, "only without an id, and twice here", 1), (None, "only without an id, and twice here", 2), (None, "One", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group int").select("text", "group", "doc_id")
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in S.deduplicated(docs).collect())
    roots = brute_components([(i, brute_fp(t)) for i, t in enumerate(TEXTS * 2)])
    assert [r[1] for r in got if not r[0]] == sorted(set(roots.values()))
    assert [r[2] for r in got if r[0]] == ["only without an id, and twice here"]
    assert S.deduplicated(docs).columns == docs.columns

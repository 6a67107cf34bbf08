import random

import corpus_pipeline as C
from helixframe.llm import near_copies as N


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_force(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both * 5 >= 4 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [rows[find(i)][0] for i in range(len(rows))]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 40, 120, 300]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(i % 4):
            other = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 35)):
                other[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(other)))
    return rows


def test_components_match_brute_force(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_copies(docs).collect()}
    want = brute_force(rows)
    assert 20 < len(rows) - len(set(want))
    assert [got[i] for i, _ in rows] == want


def test_stage_drops_near_copies_at_eighty_percent(spark, tmp_path):
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in C.near_duplicate_stage(spark, docs, str(tmp_path)).collect())
    assert got == sorted(set(brute_force(rows)))


def test_a_crowd_of_near_copies_is_one(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(80):
        other = list(words)
        other[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(other)))
    docs = spark.createDataFrame([*rows, (90, ""), (91, None), (92, "w1 w2")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_copies(docs, hot=4).collect()}
    assert [got[i] for i, _ in rows] == [0] * 80 and got[90] == got[91] == 90 and got[92] == 92


def test_empty_table(spark):
    assert N.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_repeated_id_loses_no_unlike_text_and_keeps_no_copy(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (0, "k l m n o p q"), (3, "k l m n o p q"), (3, "h i j k l m n"), (None, "x y z a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [rows[i] for i in (0, 1, 3, 5, 6)]
    for m in (N, N.simhash):
        assert sorted(map(str, map(tuple, m.deduplicated(docs).collect()))) == sorted(map(str, want))


def test_crowds_around_an_original_and_of_two_kinds(spark):
    """Copies that are similar to their original only, not to each other, and a second group that shares bands with the first."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(words))]
    for i in range(1, 50):
        other = list(words)
        for at in rng.sample(range(0, 300, 7), 6):
            other[at] = f"x{i}.{at}"
        rows.append((i, " ".join(other)))
    half = words[:150] + [f"y{i}" for i in range(150)]
    for i in range(50, 70):
        other = list(half)
        other[200 + i] = f"z{i}"
        rows.append((i, " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert len(set(want)) == 2
    for hot in (2, 8):
        got = {r.doc_id: r.component_id for r in N.near_copies(docs, hot=hot).collect()}
        assert [got[i] for i, _ in rows] == want


def test_drifting_copies_lose_no_link_in_crowded_bands(spark):
    """Each copy is like its neighbours only: hubs tie few of them, the prefix filter the others."""
    rng = random.Random(21)
    rows, lost = [], 0
    for chain in range(6):
        words = [f"c{chain}w{i}" for i in range(240)]
        for i in range(40):
            rows.append((len(rows), " ".join(words)))
            if i % 13 == 12:  # too far for a link
                for at in range(3, 240, 12):
                    words[at] = f"y{chain}.{i}.{at}"
            else:
                words[rng.randrange(240)] = f"x{chain}.{i}"
                words[rng.randrange(240)] = f"z{chain}.{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert 6 < len(set(want)) < 60
    for hot in (2, 6):
        got = {r.doc_id: r.component_id for r in N.near_copies(docs, hot=hot).collect()}
        lost += sum(got[i] != w for (i, _), w in zip(rows, want))
    assert lost == 0
    sketches = N.sketched(docs, "doc_id", "text")
    members = sketches.selectExpr("fp", "n", "explode(bands) AS band").distinct()
    sizes = members.groupBy("band").count().withColumnRenamed("count", "m").filter("m > 1")
    pairs, crowds = N.candidates(members, sizes, 2)
    sets = N.with_key(docs).select("fp", "own").distinct()
    assert not N.left_apart(crowds, N.simhash.components(N.verified(pairs.union(N.hub_pairs(crowds)).distinct(), sets))).filter("out").isEmpty()

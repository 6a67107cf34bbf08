import random
from collections import Counter

from helixframe.operators import immune
from helixframe.plans import QUERIES


def greedy(words):
    kept = []
    for s, n in sorted(Counter(words).items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        for k in kept:
            if s in k[0] or (len(s) == len(k[0]) and sum(a != b for a, b in zip(s, k[0])) <= 1):
                k[1] += n
                break
        else:
            kept.append([s, n])
    return {s: n for s, n in kept}


def test_collapse_is_the_greedy_one_at_every_length_and_count(spark, tmp_path):
    rng = random.Random(3)
    words = {l: ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 10))) for _ in range(300)] for l in ("x", "y")}
    rows = [(l, w) for l in words for w in words[l]]
    got = {(r.l, r.s): r.support for r in immune.collapsed_sequences(spark.createDataFrame(rows, "l string, s string"), "l", "s").collect()}
    want = {(l, s): n for l in words for s, n in greedy(words[l]).items()}
    assert got == want
    spark.createDataFrame([(l, " ".join(words[l])) for l in words], "lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r[0], r[1]): r[2] for r in QUERIES["receptor_collapse"](spark, str(tmp_path)).collect()} == want

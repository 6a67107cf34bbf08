import random
import re
from collections import Counter

from helixframe.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    say = lambda n: "".join(rng.choice(["a", "é", "日本", "#", "b%", "\U0001f600"]) + rng.choice([" ", "  ", "\n", "\t", " \n", "\r\n"]) for _ in range(n))
    texts = [None, "", "\n\n", " ", "word", "a\na\n a\na", "x " * 5000, "l i n e\n" * 300] + [say(rng.randrange(80)) for _ in range(60)] + [say(15) * 3, say(4000)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(300))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    rows = Q.repetition(docs.coalesce(1)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert rows[-1].kept


def test_empty_table(spark):
    assert Q.repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0

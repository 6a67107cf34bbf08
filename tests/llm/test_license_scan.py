import random
import re

from helixframe.llm import license_scan as L

RULES = L.rules()


def brute(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    form = " " + " ".join(w) + " "
    places = sorted(i for _, phrase in L.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    base = sorted({label for label, phrase in L.BASE if f" {phrase} " in form})
    found = []
    for i, (label, p, is_base, keyword, pattern) in enumerate(RULES):
        if keyword in form:
            found += [(m.start(), -m.end(), p, i) for m in re.finditer(f" (?:{pattern})(?= )", form, re.ASCII)]
    ends, kept = [-1] * 4, []
    for a, z, p, i in sorted(found):
        if max(ends[: p + 1]) < -z or RULES[i][2]:
            kept.append((p, i))
        ends[p] = max(ends[p], -z)
    labels = sorted({RULES[i][0] for _, i in kept})
    score = max((L.WEIGHTS[p] for p, _ in kept), default=0.0)
    return len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(base), ",".join(labels), score


def test_matches_brute_force(spark):
    rng = random.Random(8)
    plain = [re.sub(r"\(\?[:!=][^()]*\)\??|\[..\]|[?\\^]", " ", r[4]) for r in RULES]
    bits = ["Foo", "é", "cc by cc by", "CC-BY-SA 4.0", "MIT License", "Mit\nlicense!", "The Apache License, Version 2.0", "GNU General\tPublic License v3", "SPDX-License-Identifier: GPL-2.0-only", "xcc by", "cc byé", "All rights reserved.", "K İ cc", "gnu general public license gnu general public license"]
    texts = [None, "", "...", "cc by", "mit license " * 400]
    texts += [" ".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(80)] + [f"Foo {p} bar. {rng.choice(bits)}" for p in plain]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    rows = L.scan(docs).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in rows}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (t, got[i], brute(t))
    assert sum(bool(x[5]) for x in got.values()) > 250


def test_the_gate_covers_every_keyword():
    gate = L.gate_words([r[3] for r in RULES])
    assert len(RULES) > 300 and len(gate) < len({r[3] for r in RULES})
    assert all(set(gate) & set(r[3].split()) for r in RULES)


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0

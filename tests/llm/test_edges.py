"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns of the operators."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from helixframe.llm import chat, decontaminate, ftrl, license_scan, near_copies, packing, quality_classifier, quality_rules, simhash, toxicity, url_filter, warc
from helixframe.llm.common import in_batches, utf8

CLASH = ["__text", "__row", "__low", "__form", "__kept", "score", "n_words", "kept", "items", "fp", "group", "labels", "__own", "__id", "id"]


def texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(120_000))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "mit license"), (3, "mit license"), (4, long), (4, long), (5, "x" * 300_000), (None, "cc by"), (None, None)]
    return spark.createDataFrame([(*r, *[7] * len(CLASH)) for r in rows], ", ".join(["doc_id long", "text string", *[f"`{c}` int" for c in CLASH]])), [r[1] for r in rows]


STAGE_CLASH = ["__score", "__own_items", "items", "__id", "__fp", "__own", "__none", "__key", "__row", "__text", "id", "fp", "contaminated", "component_id"]


@pytest.mark.parametrize("labels", [[(i, 1 - i % 2, i % 2) for i in range(40)], [(i, 1, 1) for i in range(40)], [(i, 0, 0) for i in range(40)], []])
def test_stages_keep_columns_that_clash_and_all_rows_without_both_labels(spark, tmp_path, labels):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, "good" if i % 2 == 0 else "bad", str(i)] * 2)) for i in range(40)] + [(None, "odd one"), (7, "another"), (None, None)]
    kinds = ", ".join(f"`{c}` string" for c in STAGE_CLASH)
    docs = spark.createDataFrame([(*r, *["kept"] * len(STAGE_CLASH)) for r in rows], f"doc_id long, text string, {kinds}")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("1", "w3 w4 w5 nothing")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == "kept" for r in got for c in STAGE_CLASH)
        if name in ("quality", "toxicity") and len({x[1] for x in labels}) < 2:
            assert len(got) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


MODEL = ftrl.Model(np.arange(50), np.full(50, 0.01, np.float32), -1.0)
OPERATORS = {
    "license_scan": lambda d: license_scan.scan(d),
    "toxicity": lambda d: toxicity.toxicity(d, MODEL),
    "quality": lambda d: quality_classifier.quality(d, MODEL),
    "repetition": lambda d: quality_rules.repetition(d),
    "decontaminate": lambda d: decontaminate.overlaps(d, d.sparkSession.createDataFrame([(1, "mit license"), (None, "cc by"), (2, None)], "item_id long, text string")),
    "simhash": lambda d: simhash.near_duplicates(d),
    "near_copies": lambda d: near_copies.near_copies(d),
    "packing": lambda d: packing.packed(d),
    "pages": lambda d: url_filter.judged(d.withColumnRenamed("text", "url"), text_col="url"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_columns(spark, name):
    docs, every = texts(spark)
    rows = OPERATORS[name](docs).collect()
    if name != "packing":
        assert len(rows) == len(every)
    # Equal rows have equal results.
    counts = Counter(repr(r) for r in rows if "component_id" in r.__fields__ or "text" in r.__fields__)
    assert not counts or min(n for r, n in counts.items() if "doc_id=3" in r or "doc_id=4" in r) == 2
    empty = docs.limit(0)
    assert OPERATORS[name](empty).count() == 0


def test_chat_ties_clashes_and_a_long_thread(spark):
    rows = [(1, 0, "user", None, 9), (1, 0, None, "b", 9), (1, 0, "assistant", "a", 9), (1, None, "user", "last", 9), (1, None, "user", "last", 9)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"t{i}", 9) for i in range(3000)] + [(3, 0, "assistant", "y" * 400_000, 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, tree int")
    made = chat.conversations_of(chat.threads(table))
    got = {r.tree: r for r in made.select("tree", "n_turns", chat.read_back(made["formatted"]).alias("turns"), chat.under_loss(made["formatted"], made["loss"]).alias("lost")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", "b"), ("assistant", "a"), ("user", ""), ("user", "last"), ("user", "last")]
    assert got[2].n_turns == 3000 and [t.text for t in got[2].turns] == [f"t{i}" for i in range(3000)]
    assert got[2].lost == "".join(f"t{i}" for i in range(1, 3000, 2)) and got[3].lost == "y" * 400_000
    # Branches of equal score: the lesser leaf comes first.
    tree = spark.createDataFrame([(1, 0, None, "user", "q", 1.0), (1, 2, 0, "assistant", "b", 0.5), (1, 1, 0, "assistant", "a", 0.5)], "tree long, node int, parent int, role string, text string, score double")
    assert [r.formatted.count("\na</turn>") for r in chat.conversations_of(tree, 2).orderBy("rank").collect()] == [1, 0]
    assert chat.conversations_of(tree.limit(0)).count() == 0


def test_the_chat_query_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [(r.conv_id, r.n_turns) for r in chat.op2_chat(spark, str(tmp_path)).collect()] == [(-7, 2)]


def test_the_pipeline_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_dictionary_of_equal_pages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "same " * 400) for i in range(50)] + [(None, None, None)], "page_id long, url string, html string")
    assert warc.dictionary_of(pages, samples=4) and warc.dictionary_of(pages.limit(0))


def brute_train(rows, labels, rates):
    """FTRL-proximal, one coordinate at a time."""
    n, z, bias = {}, {}, 1 << ftrl.BITS

    def weight(i):
        limit = 0.0 if i == bias else rates.l1
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= limit else -(zi - math.copysign(limit, zi)) / ((rates.beta + math.sqrt(n.get(i, 0.0))) / rates.alpha + rates.l2)

    for _ in range(rates.epochs):
        for row, y in zip(rows, labels):
            some = [*row, bias]
            w = {i: weight(i) for i in some}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in some:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / rates.alpha * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z if i != bias and weight(i)}, weight(bias)


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_training_matches_one_coordinate_at_a_time(module):
    rng = random.Random(1)
    said = [" ".join(rng.choice(["good", "BAD", "ugly!", "fine,", "7"]) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    labels = [int("BAD" in s) for s in said]
    data, at = utf8(pa.array(said))
    row, index = module.features(data, at)
    rows = [np.unique(index[row == k]) for k in range(len(said))]
    rates = ftrl.Rates(alpha=0.7, l1=0.3, l2=0.2, epochs=3)
    model = ftrl.train(rows, np.array(labels), rates)
    want, bias = brute_train([r.tolist() for r in rows], labels, rates)
    assert model.index.tolist() == sorted(want) and model.bias == pytest.approx(bias, abs=1e-9)
    assert model.weight.tolist() == pytest.approx([want[i] for i in sorted(want)], abs=1e-6)


def test_the_sample_of_labels_is_that_of_the_least_hashes(spark):
    known = spark.range(5000).selectExpr("id", "xxhash64(cast(id as string)) AS k", "0 AS y").unionAll(spark.range(10).selectExpr("id", "xxhash64(cast(id as string))", "0"))
    want = sorted((r.k, r.id) for r in known.collect())
    for most in (1, 700, 10_000):
        got = sorted((r.k, r.id) for r in ftrl._least(known, most).collect())
        assert got == want[:most]


def test_kept_matches_plain_python(spark):
    rng = random.Random(6)
    said = [" ".join(f"w{rng.randrange(rng.choice([6, 30, 400]))}" for _ in range(rng.randrange(5, 160))) for _ in range(50)]
    said += ["\n".join(rng.choice(said[:4]) for _ in range(k)) for k in (2, 3, 5)] + ["é ü " * 30]
    for r in quality_rules.repetition(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect():
        words = said[r.doc_id].split()
        chars = sum(map(len, words))
        share = []
        for k, most in quality_rules.GRAM_SHARES.items():
            grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            many = Counter(grams)
            hit = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(k)}
            share.append((sum(len(words[i]) for i in hit) / chars, most))
        lines = [x for x in said[r.doc_id].split("\n") if x.split()]
        again = [x for i, x in enumerate(lines) if x in lines[:i]]
        dup = sum(len("".join(x.split())) for x in again)
        over = any(s > m for s, m in share) or len(again) / len(lines) > quality_rules.LINE_SHARE or dup / chars > quality_rules.LINE_CHARS
        assert r.kept == (not r.base_failed and not over) and r.dup_gram_share == pytest.approx(max(s for s, _ in share)) and r.dup_line_share == pytest.approx(len(again) / len(lines))


def test_batches_are_bounded_in_bytes(spark):
    docs = spark.range(400).selectExpr("id", "repeat('x', 200000) AS text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    assert max(r.n for r in in_batches(docs).mapInArrow(sizes, "n long").collect()) <= 30

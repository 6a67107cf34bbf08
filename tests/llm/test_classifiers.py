import random
import zlib

import numpy as np
import pytest

from helixframe.llm import ftrl
from helixframe.llm import quality_classifier as Q
from helixframe.llm import toxicity as T


def corpus(n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 120))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        for k in range(3 * toxic):
            words.insert(rng.randrange(len(words)), ["vile", "rotten", "Scoundrel"][k])
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words for _ in range(4)]
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, good, toxic))
    return rows, labels


@pytest.mark.parametrize(("module", "label", "folds", "fold"), [(T, "toxic", 5, 0), (Q, "quality", 3, 1)])
def test_held_out_accuracy(spark, module, label, folds, fold):
    rows, labels = corpus()
    extra = [(10_000, None, 0.1), (10_001, "", 0.1), (None, "a b", 0.1), (0, rows[0][1], 0.2)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (10_000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, known)
    out = (module.toxicity if module is T else module.quality)(docs, model)
    assert sorted(out.columns) == sorted(docs.columns)
    got = [(r.doc_id, r.score) for r in out.collect()]
    assert len(got) == len(rows) + len(extra) and all(0 <= s <= 1 for _, s in got)
    want = {i: (q if label == "quality" else t) for i, q, t in labels}
    held = [(want[i], s >= 0.5) for i, s in got if i in want and zlib.crc32(str(i).encode()) % folds == fold]
    assert sum(bool(y) == p for y, p in held) > 0.95 * len(held)


def test_score_is_the_dot_product_of_present_features():
    texts = ["a b a", "", "b b b b c"]
    at = np.cumsum([0, *map(len, texts)])
    row, index = T.features(np.frombuffer("".join(texts).encode(), np.uint8), at)
    model = ftrl.Model(np.unique(index), np.linspace(-1, 1, len(np.unique(index))).astype(np.float32), 0.25)
    got = ftrl.scores(model, model.dense(), 3, row, index)
    for k in range(3):
        total = 0.25 + sum(model.dense()[i] for i in set(index[row == k].tolist()))
        assert abs(got[k] - 1 / (1 + np.exp(-total))) < 1e-6


def test_one_class_and_no_rows():
    assert ftrl.train([], np.zeros(0)).bias == 0
    assert ftrl.train([np.array([1], np.int32)], np.array([1])).bias > 0


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.toxicity(docs, T.fit(docs, labels)).count() == 0

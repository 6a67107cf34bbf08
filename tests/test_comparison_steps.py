"""The pairs of tolerant_comparison differ by a base, a lost base and a run that is three bases longer; and whole sequences are compared."""

import random

import pytest

from helixframe.plans import QUERIES


@pytest.mark.parametrize("name", ["tolerant_comparison"])
def test_base_loss_and_run(spark, tmp_path, name):
    r = random.Random(4)
    texts = {i: "".join(r.choice("acgt") for _ in range(n)) for i, n in enumerate([1300, 120, 121, 65, 5, 0])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.doc_id, x.k): x for x in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, k) for i, t in texts.items() for k in range(-(-len(t) // 120))}
    for (i, k), x in got.items():
        size = min(120, len(texts[i]) - 120 * k)
        at = 10 + (i + 7 * k) % 60
        base = (0.0, 0.3, 1.0)[k % 3] if at < size else 0.0
        if size == 120:  # the base, the loss and the run, which is stepped over at once, where nothing cheaper aligns them
            assert x.overlap >= 130 and x.penalty <= base + 2
            assert x.alike
        elif size <= at:
            assert (x.penalty, x.overlap, x.alike) == (0, size, True)
    whole = [(x.penalty, k % 3) for (i, k), x in got.items() if min(120, len(texts[i]) - 120 * k) == 120]
    assert sum(p == pytest.approx((2.0, 2.3, 3.0)[c]) for p, c in whole) >= 0.7 * len(whole)

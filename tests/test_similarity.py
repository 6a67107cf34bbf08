"""Cosine similarities by blocks equal the SQL, on odd vectors too, and sums near the middle of two rounded values."""

import math
import random

import duckdb
import numpy as np

from helixframe.operators import similarity as V
from helixframe.plans import ORACLES, QUERIES


def test_equals_sql_on_odd_vectors(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)], 0) for i in range(700)]
    odd = [None, [], [None], [0.0] * 16, [1.0], [1.0, None, 3.0], [None, 2.0], [2.0] * 20, [-1.0] * 16, [float("nan")] * 16]
    rows += [(100000 + 50 * i, x, 1) for i, x in enumerate(odd)] + [(200000 + 100 * i, x, 1) for i, x in enumerate(odd)] + [(None, [1.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    plain = lambda x: (x[0], -1 if x[1] is None else x[1], repr(None if x[2] is None or math.isnan(x[2]) else x[2] + 0.0))
    want = sorted(map(plain, con.execute(f"SELECT q, vec_id, similarity FROM ({ORACLES['cosine_sim']})").fetchall()))
    got = sorted(plain((x.q, x.vec_id, x.similarity)) for x in QUERIES["cosine_sim"](spark, str(tmp_path)).collect())
    assert got == want and len(got) == len(rows) * sum(x[0] is not None and x[0] % 100 == 0 for x in rows)


def test_near_the_middle_of_two_values():
    rng = np.random.default_rng(1)
    # Small whole numbers: many cosines are the middle of two values with one or two digits.
    x = rng.integers(-2, 3, (60, 8)).astype(float)
    y = rng.integers(-2, 3, (500, 8)).astype(float)
    for digits in (1, 2, 6):
        got, null = V.rounded_cosines(x, None, y, None, digits)
        assert null is None
        for i in range(len(x)):
            for j in range(len(y)):
                dot = xx = yy = 0.0
                for a, b in zip(x[i], y[j]):
                    dot, xx, yy = dot + a * b, xx + a * a, yy + b * b
                if not xx * yy:
                    assert math.isnan(got[i, j])
                    continue
                t = dot / math.sqrt(xx * yy) * 10.0**digits
                assert got[i, j] == math.copysign(math.floor(abs(t) + 0.5), t) / 10.0**digits + 0.0

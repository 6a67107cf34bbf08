from helixframe.operators import assembly as A
from helixframe.operators import intervals as I


def test_pairs_grow_with_places_and_not_with_rows(spark, monkeypatch):
    sides = []
    whole = I.range_join
    monkeypatch.setattr(I, "range_join", lambda left, right, *a, **k: sides.append((left.count(), right.count())) or whole(left, right, *a, **k))
    breakends = [(i, "1", 100 + i % 2, 1 if i % 3 else None) for i in range(200)] + [(900, None, 100, 1), (901, "2", 100, 1)]
    known = [(v, b, "1", 98 + v % 4, -1 if v % 5 else 1) for v in range(200, 0, -1) for b in (1, 0)]
    rows = spark.createDataFrame(breakends, "id long, chromosome string, position long, orientation int")
    got = {r.id: (r.variant, r.breakend, r.distance) for r in A.nearest_known(rows, spark.createDataFrame(known, "variant long, breakend int, chromosome string, position long, orientation int"), 4).collect()}
    # A comparison with a missing orientation is null, which comes first.
    other = lambda o, p: -1 if p is None else int(o != p)
    for i, c, p, o in breakends:
        best = min(((abs(p - q), other(w, o), v, b) for v, b, d, q, w in known if d == c and abs(p - q) <= 4), default=None)
        assert got[i] == ((best[2], best[3], best[0]) if best else (None, None, None))
    assert len(got) == len(breakends) and all(x <= 10 for side in sides for x in side)

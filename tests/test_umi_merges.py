import random

from helixframe.operators import fragments as X
from helixframe.operators import graph


def brute(rows, jitter):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def tie(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    for x in rows:
        for y in rows:
            if x[0] == y[0]:
                continue
            if x[4] and y[4] and x[1] == y[1] and ((x[2] == y[2] and abs(x[3] - y[3]) <= jitter) or (x[3] == y[3] and abs(x[2] - y[2]) <= jitter)):
                tie(x[0], y[0])
            if not x[4] and x[1].endswith("G") and x[2] == y[2] and len(x[1]) == len(y[1]) and y[1].startswith(x[1].rstrip("G")):
                tie(x[0], y[0])
    return {r[0]: find(r[0]) for r in rows}


def test_links_grow_with_groups(spark, monkeypatch):
    """Many groups of one end, a third of them unmapped: as many links as groups, not one for each pair, and the same components."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["ACGTA", "ACGGG", "ACGTG", "TTTGG", "CCCCC", "GGG", "ACG", "ACT"]), rng.randrange(3), rng.randrange(400), rng.random() < 0.7) for i in range(400)]
    links, plain = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges, a, b: (links.append(edges.count()), plain(edges, a, b))[1])
    got = X.merged_groups(spark.createDataFrame(rows, "id long, umi string, five long, three long, mapped boolean"), 10)
    assert {r.id: r.merged for r in got.collect()} == brute(rows, 10)
    assert links[0] < 4 * len(rows)

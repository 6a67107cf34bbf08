"""Positions released by a scan's progress: order, bounded state, late reads and the end of a scan."""

import json
import random
from collections import defaultdict

from helixframe.streaming import positions as P


def scanned(spark, tmp_path, batches, reach):
    """The rows in the order in which the stream gave them, by batch."""
    source = f"{tmp_path}/in"
    own = P.with_map_state(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    out = []
    for i, rows in enumerate(batches):
        own.createDataFrame(rows, "contig string, position long, value double").coalesce(1).write.mode("append").parquet(f"{source}/b={i:03d}")
    stream = own.readStream.schema("contig string, position long, value double, b int").option("maxFilesPerTrigger", 1).parquet(source).drop("b")
    query = P.released(stream, "contig", "position", "value", reach).writeStream.outputMode("append").foreachBatch(lambda df, k: out.append([tuple(r) for r in df.collect()])).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(240)
    states = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p.numInputRows]
    return out, states


def test_released_in_order_with_bounded_state(spark, tmp_path):
    r = random.Random(3)
    reach, batches, want = 20, [], defaultdict(lambda: [0, 0.0])
    for i in range(8):
        rows = []
        for contig in ("c1", "c2"):
            for _ in range(60):
                p = i * 50 + r.randrange(50) - r.randrange(10)
                p = max(p, i * 50 - 10, 0)
                rows.append((contig, p, float(r.randrange(5))))
                want[contig, p][0] += 1
                want[contig, p][1] += rows[-1][2]
        r.shuffle(rows)
        batches.append(rows)
    batches.append([("c1", None, None), ("c2", None, None)])
    out, states = scanned(spark, tmp_path, batches, reach)
    seen = defaultdict(list)
    for batch in out:
        for contig, p, n, total, late in batch:
            assert not late and want[contig, p] == [n, total]
            seen[contig].append(p)
    assert sum(map(len, seen.values())) == len(want)
    for own in seen.values():
        assert own == sorted(own)
    # Two keys, each with a row of progress and the positions of a reach and a batch's disorder at most.
    assert max(states) <= 2 * (reach + 2 + 1)
    # Nothing is held back that the scan has passed.
    furthest = max(p for _, p, _ in batches[0])
    first = [p for c, p, *_ in out[0] if c == "c1"]
    assert first and max(first) <= furthest - reach - 1


def test_late_reads_and_nulls(spark, tmp_path):
    out, _ = scanned(spark, tmp_path, [[("c1", 1, 1.0), ("c1", 100, None)], [("c1", 1, 2.0), ("c1", 2, 3.0), ("c1", 95, 5.0)], [("c1", None, None)]], 10)
    assert sorted(out[0]) == [("c1", 1, 1, 1.0, False)]
    assert sorted(out[1]) == [("c1", 1, 1, 2.0, True), ("c1", 2, 1, 3.0, True)]
    assert out[2] == [("c1", 95, 1, 5.0, False), ("c1", 100, 1, 0.0, False)]

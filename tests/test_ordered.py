"""Sums of doubles are added up in the order of the table's rows, as the SQL does on one thread."""

import random

import duckdb
import pytest

from helixframe.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Items in two files, with sums on both sides of the thresholds by rounding alone."""
    d = tmp_path_factory.mktemp("ordered")
    r = random.Random(3)
    # Of each sample's 22 chromosomes 14 pairs of items, whose means are 25.5 and 0.051 but for rounding.
    pairs = [[(r.randrange(6000), s, c + 22 * r.randrange(100), q, d, t) for q, d in ((17.0, 0.051 - away), (34.0, 0.051 + away))] for s in range(40) for c in range(22) for _ in range(14) for away, t in [(r.random() / 20, r.randrange(1, 9) / 100)]]
    rows = [(*x[:4], r.choice([0.03, 0.04, 0.05, 0.06, 0.07]) if x[1] % 2 else x[4], x[5]) for p in pairs for x in p]
    r.shuffle(rows)
    schema = "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_tax double"
    for part, some in enumerate((rows[:9000], rows[9000:])):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(d / f"part{part}"))
    (d / "lineitem.parquet").mkdir()
    # The larger file is the second by name and the first that Spark would read.
    for part in (0, 1):
        found = next((d / f"part{part}").glob("*.parquet"))
        (d / "lineitem.parquet" / f"{part}.parquet").write_bytes(found.read_bytes())
    return str(d)


@pytest.mark.parametrize("name", ["forest_classifier", "genome_duplication", "qc_status", "qc_worst"])
def test_equals_sql_on_one_thread(spark, folder, name):
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    got = con.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    want = sorted(got.fetchall())
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20000)
    try:
        found = sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, folder).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == want

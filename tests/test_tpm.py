import duckdb
import pytest

from helixframe.plans import ORACLES, QUERIES


def test_enriched_genes_beyond_the_test_tables(spark, tmp_path):
    rows = [(1, g, 1.0 + g % 7) for g in (*range(1, 400), *range(20300, 20700), 97 * 300, 97 * 5000)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {r[:2]: r[2] for r in duck.sql(ORACLES["tpm_capped"]).fetchall()}
    got = {(r.s, r.g): r.tpm for r in QUERIES["tpm_capped"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)

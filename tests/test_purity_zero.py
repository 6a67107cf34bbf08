from helixframe.functions import purity as P
from helixframe.plans import ORACLES, QUERIES


def test_a_ratio_of_zero_is_as_in_the_sql(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    rows = [(i, v) for i, v in enumerate([0.0, 0.0, 0.0, 0.01, -0.01, 5000.0])]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = duckdb.sql(ORACLES["purity_expressions"]).fetchall()
    got = [tuple(r) for r in QUERIES["purity_expressions"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    one = spark.range(1).select(P.adjusted_copy_number(F.lit(0.6), F.lit(0.9), F.lit(0.0), F.lit(1.0)).alias("cn")).first()
    assert one.cn == 0.0

from helixframe.operators import immune

KNOWN = {"A": {"*1": {}, "*2": {"e1": 1}, "*3": {"e2": 1}}}


def test_groups_are_rows_of_a_batch(spark):
    rows = [("s1", "A", "e1", 1), ("s1", "A", "e2", 1), ("s2", "A", "e1", None), ("s3", "A", "e1", 0), (None, "A", "e1", 2), ("s1", "B", "e9", 1)]
    df = immune.called_haplotypes(spark.createDataFrame(rows, "sample string, gene string, event string, count long"), KNOWN, {"A": "*1"})
    got = {tuple(r) for r in df.collect()}
    assert got == {("s1", "A", "*2", 1), ("s1", "A", "*3", 1), ("s2", "A", "Unresolved", 0), ("s3", "A", "*1", 2), (None, "A", "*2", 2), ("s1", "B", "Unresolved", 0)}
    # A pandas frame for each group took over a millisecond each.
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()

from helixframe.operators import reverse as R


def test_a_change_is_read_once(spark):
    changes = spark.createDataFrame([("a", "t", "p.Met1Val"), ("b", "t", "p.K2del"), ("c", "t", "p.K2dup"), ("d", "t", None), ("e", "t", "p.K99999999999del"), ("f", "t", "p.M2V")], "id string, transcript string, protein string")
    t = spark.createDataFrame([("t", "g", "c", 1, 1, 12, 1, 12)], "transcript string, gene string, chromosome string, strand int, trans_start long, trans_end long, coding_start long, coding_end long")
    exons = spark.createDataFrame([("t", 1, 12)], "transcript string, exon_start long, exon_end long")
    got = R.variants_behind(changes, t, exons, spark.createDataFrame([("t", "ATGAAACCCTAA")], "transcript string, bases string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Ala") <= 3  # one for each kind
    assert {tuple(r)[:1] + tuple(r)[3:] for r in got.collect() if r.id != "b"} == {("a", 1, "A", "G"), *{("a", 1, "ATG", f"GT{x}") for x in "ACT"}, ("c", 6, "", "AAA")}
    assert ("b", 4, "AAA", "") in {tuple(r)[:1] + tuple(r)[3:] for r in got.collect()}

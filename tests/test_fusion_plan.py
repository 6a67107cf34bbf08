from helixframe.operators import rna as R

COLUMNS = "id int, known_pair boolean, known_gene boolean, up_type string, down_type string, fragments double, af_up double, af_down double, anchor_up int, anchor_down int, cohort int"


def test_a_tier_is_computed_once(spark):
    rows = [(0, False, False, "CANONICAL", "KNOWN", 2.0, 0.004, 0.1, 30, 30, 3), (1, True, True, "UNKNOWN", None, 4.0, 0.0, 0.0, 0, 0, 9), (2, False, False, "KNOWN", None, 10.0, 0.05, 0.05, 20, 19, 2), (3, False, False, "KNOWN", "KNOWN", 2.0, 0.002, 0.002, 20, 20, 2)]
    got = R.fusion_filters(spark.createDataFrame(rows, COLUMNS))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SPLICE_CANONICAL") < 10
    assert {r.id: (r.tier, r.filters) for r in got.collect()} == {0: ("SPLICE_CANONICAL", "min_fragment_support;min_af;max_cohort_frequency"), 1: ("KNOWN", "PASS"), 2: ("OTHER", "min_anchor"), 3: ("SPLICE_SPLICE", "PASS")}

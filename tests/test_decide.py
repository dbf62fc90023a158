import pytest
from pyspark.sql import functions as F

from armscope.operators import decide, multiple, proportions
from armscope.operators.multiple import Metric
from armscope.plans.statistical import statistical_analysis


@pytest.mark.parametrize(
    "sig, up, practical, worse, differ, weak, ok, want",
    [
        (True, True, "useful", False, False, False, True, "launch"),
        (True, True, "positive_size_open", False, True, False, True, "launch_by_segment"),
        (True, True, "negligible", False, False, False, True, "do_not_launch"),
        (True, False, "harmful", False, False, False, True, "do_not_launch"),
        (True, True, "useful", True, False, False, True, "do_not_launch"),
        (True, True, "useful", False, False, False, False, "redesign"),
        (False, True, "negligible", False, False, True, True, "do_not_launch"),
        (False, True, "inconclusive", False, False, True, True, "redesign"),
        (False, True, "inconclusive", False, False, False, True, "continue"),
    ],
)
def test_decision_rules(spark, sig, up, practical, worse, differ, weak, ok, want):
    code = decide.decision_code(*[F.lit(v) for v in (sig, up, practical, worse, differ, weak, ok)])
    assert spark.range(1).select(code.alias("d")).first().d == want


def test_practical_significance(spark, spec):
    rows = [("a", -0.05, -0.06, -0.04), ("b", -0.005, -0.008, 0.002), ("c", 0.03, 0.01, 0.05), ("d", -0.02, -0.05, 0.01),
            ("e", -0.02, -0.05, -0.001)]
    df = spark.createDataFrame(rows, "k string, diff double, ci_low double, ci_high double")
    got = {r.k: (r.practical, r.practical_action) for r in decide.practical_significance(df, spec, 0.01).collect()}
    assert got == {"a": ("useful", "launch"), "b": ("negligible", "stop"), "c": ("harmful", "stop"),
                   "d": ("inconclusive", "continue"), "e": ("positive_size_open", "continue")}


def test_guardrails(spark, spec):
    rows = [("x", "control" if i % 2 else "treatment", 5.0 if i % 2 else 9.0 + i % 3, 1.0 + i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "experiment string, group string, latency double, noise double")
    tests = multiple.metric_tests(df, spec, [Metric("latency", "latency", "guardrail", -1), Metric("noise", "noise", "guardrail")])
    row = decide.guardrail_status(tests, spec).first()
    assert (row.n_guardrails, row.n_worse, row.blocks_launch) == (2, 1, True)


def test_subgroup_actions(units, spec):
    cells = [("control", "US", 1, 100), ("control", "US", 0, 300), ("treatment", "US", 1, 200), ("treatment", "US", 0, 200),
             ("control", "UK", 1, 200), ("control", "UK", 0, 200), ("treatment", "UK", 1, 100), ("treatment", "UK", 0, 300),
             ("control", "CA", 1, 100), ("control", "CA", 0, 100), ("treatment", "CA", 1, 101), ("treatment", "CA", 0, 99)]
    effects = proportions.subgroup_effects(units(cells), spec, ["country"])
    actions = {r.country: r.action for r in decide.subgroup_actions(effects).collect()}
    assert actions == {"US": "launch", "UK": "hold", "CA": "undecided"}
    row = decide.subgroup_consistency(effects, spec).first()
    assert (row.n_subgroups, row.n_harmed, row.n_helped, row.any_harmed, row.same_sign) == (3, 1, 1, True, False)


def test_whole_analysis(spark, spec):
    # A planted lift of ten points in both countries.
    log = spark.range(8000).select(
        F.lit("x").alias("experiment"), F.col("id").alias("seq"), F.col("id").alias("user_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 2 == 0, "control").otherwise("treatment").alias("group"),
        F.when(F.col("id") % 2 == 0, "old_page").otherwise("new_page").alias("landing_page"),
        (F.col("id") % 20 < F.when(F.col("id") % 2 == 0, 4).otherwise(6)).cast("int").alias("converted"),
        (F.col("id") % 50).cast("double").alias("amount"))
    country = F.when(F.floor(F.col("user_id") / 20) % 3 == 0, "UK").otherwise("US")
    countries = log.select("user_id", country.alias("country"))
    out = statistical_analysis(log, countries, spec, auxiliary="amount", min_effect=0.001)
    record = out["decision"].first()
    assert record.significant and record.effect > 0 and not record.strata_disagree
    assert record.decision == "launch" and record.next_step == "monitor_after_launch"
    matrix = {r.dimension: r.points_to for r in out["decision_matrix"].collect()}
    assert matrix["significance"] == "launch" and len(matrix) == 8
    for name, df in out.items():
        assert df.count() > 0, name

import pytest
from pyspark.sql import functions as F

from armscope.operators.joins import attach_per_group
from armscope.plans import charts
from armscope.plans.modelling import model_analysis


def test_joins_agree_on_both_sides_of_the_bound(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4), ("c", 5)], "g string, v int")
    groups = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "g string, w int")
    small, large = (
        sorted(map(tuple, attach_per_group(rows, groups, ["g"], broadcast_rows=n).collect()), key=repr) for n in (10, 0)
    )
    assert small == large == sorted([("a", 1, 10), ("a", 2, 10), (None, 3, 20), ("b", 4, 30)], key=repr)
    plan = attach_per_group(rows, groups, ["g"], broadcast_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan


def test_model_analysis(spark, spec):
    ids = spark.range(3000).withColumns(
        {
            "experiment": F.lit("x"),
            "group": F.when(F.col("id") % 2 == 0, "control").otherwise("treatment"),
            "country": F.element_at(F.array(*[F.lit(c) for c in ("US", "UK", "CA")]), (F.pmod(F.hash("id"), F.lit(3)) + 1)),
            "time_seconds": F.pmod(F.xxhash64("id"), F.lit(3600)).cast("double"),
        }
    )
    # Late visitors convert more often.
    rows = ids.withColumn("converted", (F.col("time_seconds") + F.pmod(F.hash("id", "country"), F.lit(3600)) > 4200).cast("int"))
    out = model_analysis(
        rows, spec, ["US", "UK", "CA"], ["id"],
        forest_settings={"numTrees": 5, "maxDepth": 4}, boosting_settings={"maxIter": 3, "maxDepth": 3},
    )
    collected = {name: df.collect() for name, df in out.items()}
    assert {r.model for r in collected["model_comparison"]} == {"logistic_regression", "random_forest", "gradient_boosting"}
    assert all(r.auc > 0.75 for r in collected["model_comparison"])
    # The bucket is a step function of the time, so either may come first.
    assert collected["forest_importances"][0].feature in ("time_seconds", "time_min_bucket", "quick_user")
    assert {r.term for r in collected["interaction_terms"]} == {
        "treatment_x_time", "treatment_x_US", "treatment_x_UK", "treatment_x_quick"}
    assert len(collected["subgroup_effects"]) == 6
    assert collected["adjustment"][0].variance_reduction_pct > 10
    for name in ("logistic_regression", "random_forest", "gradient_boosting"):
        assert collected[f"validation_{name}"][0].folds == 5


def test_conversion_rates_add_up(units, spec):
    df = units([("control", "US", 1, 3), ("control", "UK", 0, 1), ("treatment", "US", 0, 2)])
    got = {(r.country, r.arm): (r.n, r.total) for r in charts.conversion_rates(df, spec).collect()}
    assert got == {("US", "control"): (3, 3), ("UK", "control"): (1, 0), ("ALL", "control"): (4, 3),
                   ("US", "treatment"): (2, 0), ("ALL", "treatment"): (2, 0)}
    assert [r.rate_pct for r in charts.conversion_rates(df, spec).collect() if (r.country, r.arm) == ("ALL", "control")] == [pytest.approx(75)]

"""Every treatment gets its row, and no model pools experiments."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from armscope.functions.tails import chi_square_tail, student_two_sided
from armscope.operators import design, models, multiple, ranks, timeline, variance
from armscope.spec import ExperimentSpec

SPEC = ExperimentSpec()
THREE = replace(SPEC, treatments=("treatment", "t2"))


@pytest.fixture(scope="module")
def rows(spark):
    data = spark.range(600).select(
        F.lit("x").alias("experiment"),
        F.col("id").alias("user_id"),
        F.element_at(F.array(F.lit("control"), F.lit("treatment"), F.lit("t2")), (F.col("id") % 3 + 1).cast("int")).alias("group"),
        (F.col("id") % 7 == F.col("id") % 2).cast("int").alias("converted"),
        (F.col("id") * 37 % 101).cast("double").alias("time_seconds"),
        (F.col("id") * 53 % 89).cast("double").alias("pre"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 3 as int))").alias("ts"),
    )
    return data.persist()


OPERATORS = {
    "mann_whitney": lambda d, s: ranks.mann_whitney(d, s),
    "cuped_report": lambda d, s: variance.cuped_report(d, s, "time_seconds", "pre"),
    "ancova": lambda d, s: variance.ancova(d, s, "time_seconds", "pre"),
    "lift_by_exposure_day": lambda d, s: timeline.lift_by_exposure_day(d, s),
    "peeking_guard": lambda d, s: timeline.peeking_guard(d, s, 100),
    "quasi_poisson": lambda d, s: multiple.quasi_poisson(d, s, "converted"),
    "smd": lambda d, s: design.standardised_differences(d, s, ["pre"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_treatment_as_if_alone(rows, name):
    both = OPERATORS[name](rows, THREE)
    for arm in THREE.treatments:
        alone = OPERATORS[name](rows.filter(F.col("group").isin("control", arm)), replace(SPEC, treatments=(arm,)))
        got = sorted(map(repr, both.filter(F.col("treatment") == arm).select(*alone.columns).collect()))
        assert got == sorted(map(repr, alone.collect())), name


def test_fleet_fit_keeps_experiments_apart(spark):
    up = spark.range(800).select(
        F.lit("up").alias("experiment"), (F.col("id") % 2).alias("is_treatment"), (F.col("id") % 5 < 1 + F.col("id") % 2 * 2).cast("int").alias("y")
    )
    down = up.select(F.lit("down").alias("experiment"), (1 - F.col("is_treatment")).alias("is_treatment"), "y")
    flat = up.filter("is_treatment = 1").withColumn("experiment", F.lit("one arm"))
    both = up.unionByName(down)
    got = {(r.experiment, r.term): r for r in models.fleet_glm(both.unionByName(flat), SPEC, "y", ["is_treatment"]).collect()}
    a, b = got["up", "is_treatment"].coef, got["down", "is_treatment"].coef
    assert a > 0.5 and abs(a + b) < 1e-8
    assert got["one arm", "is_treatment"].coef is None
    alone = {r.term: r for r in models.logit_table(up, "y", ["is_treatment"], SPEC).collect()}
    assert abs(alone["is_treatment"].coef - a) < 1e-6 and abs(alone["is_treatment"].se - got["up", "is_treatment"].se) < 1e-6
    with pytest.raises(ValueError, match="several"):
        models.logit_table(both, "y", ["is_treatment"], SPEC)


def test_tails_at_many_degrees_of_freedom(spark):
    cases = [(1500.0, 1500, 0.4951441933), (2000.0, 2000, 0.4957947558), (100000.0, 100000, 0.4994052922), (0.0, 4, 1.0)]
    table = spark.createDataFrame(cases, "x double, df int, want double")
    for r in table.withColumn("p", chi_square_tail(F.col("x"), F.col("df"))).collect():
        assert abs(r.p - r.want) < 1e-6
    p = student_two_sided([1.0, 1.0, 2.0], [1e10, 1e15, 5.0])
    assert abs(p[0] - 0.3173105079) < 1e-8 and abs(p[1] - 0.3173105079) < 1e-8 and abs(p[2] - 0.1019394788) < 1e-9

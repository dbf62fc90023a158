"""Fits of many groups at once, folds and out-of-fold scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from armscope.operators import models, newton, sampling

SCHEMA = "experiment string, seq long, x double, z double, converted int"


def rows_of(name, n, slope, seed):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(0, 1, n), rng.normal(5, 2, n)
    y = rng.random(n) < 1 / (1 + np.exp(-(0.3 + slope * x)))
    return [(name, i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, z, y))]


def plain_logit(rows, columns=(2, 3)):
    """Newton's method on one group, whole in memory."""
    x = np.array([[1.0, *[r[c] for c in columns]] for r in rows])
    y, beta = np.array([r[4] for r in rows], float), np.zeros(1 + len(columns))
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
    return beta


def test_each_group_has_its_own_fit(spark):
    groups = {"a": rows_of("a", 700, 1.0, 1), None: rows_of(None, 500, -2.0, 2), "b": rows_of("b", 60, 0.0, 3)}
    odd = [("a", 9000, None, 1.0, 1), ("a", 9001, 1.0, 1.0, None), ("none", 1, None, 1.0, 1)]
    odd += [("constant", i, float(i % 7), 2.0, i % 2) for i in range(50)]
    odd += [("one class", i, float(i), float(i % 3), 1) for i in range(30)]
    df = spark.createDataFrame([r for rs in groups.values() for r in rs] + odd, SCHEMA)
    fits = {r.experiment: r for r in newton.newton_fits(df, ["experiment"], "converted", ["x", "z"]).collect()}
    assert set(fits) == {"a", None, "b", "constant", "one class"}
    for name, rows in groups.items():
        assert fits[name].status == newton.CONVERGED and fits[name].n == len(rows)
        assert np.allclose(fits[name].beta, plain_logit(rows), atol=1e-8)
    assert fits["constant"].status == newton.SINGULAR and fits["constant"].errors is None
    assert fits["one class"].status != newton.CONVERGED


def test_separated_outcomes_do_not_converge(spark, spec):
    rows = [("x", i, float(i), float((i * 7) % 5), int(i >= 20)) for i in range(40)]
    table = models.fleet_glm(spark.createDataFrame(rows, SCHEMA), spec, "converted", ["x", "z"]).collect()
    assert len(table) == 3 and not any(r.converged for r in table)
    assert all(r.coef is None and r.p_value is None for r in table)


def test_a_step_too_far_is_halved():
    state = {"beta": [8.0], "held": [2.0], "held_ll": -10.0, "ll": -30.0, "halvings": 0, "cells": [1.0], "slope": [0.0], "status": newton.OPEN}
    new = newton.advance(state, 1, 1e-9)
    assert new["beta"] == [5.0] and new["halvings"] == 1 and new["held"] == [2.0]
    assert newton.advance({**state, "ll": float("nan"), "held": None}, 1, 1e-9)["status"] == newton.SINGULAR
    better = newton.advance({**state, "ll": -5.0, "slope": [0.5], "cells": [2.0]}, 1, 1e-9)
    assert better["held"] == [8.0] and better["beta"] == [8.25]


def test_many_groups_in_few_steps(spark):
    df = spark.range(40_000).select(
        (F.col("id") % 2000).cast("string").alias("experiment"), F.col("id").alias("seq"),
        (F.hash("id") % 100 / 50.0).alias("x"), F.lit(0.0).alias("z"), (F.hash("id", F.lit(3)) % 2 == 0).cast("int").alias("converted"),
    )
    fits = newton.newton_fits(df, ["experiment"], "converted", ["x"])
    assert fits.count() == 2000
    assert fits.where(F.col("status") == newton.CONVERGED).count() > 1900


def test_poisson_with_exposure(spark):
    rng = np.random.default_rng(5)
    rows = [("x", i, float(i % 2), float(np.log(1 + i % 9)), int(rng.poisson((1 + i % 9) * (0.5 + 0.5 * (i % 2))))) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    fit = newton.newton_fits(df, ["experiment"], "converted", ["x"], "poisson", "z").first()
    rate = [sum(r[4] for r in rows if r[2] == a) / sum(np.exp(r[3]) for r in rows if r[2] == a) for a in (0, 1)]
    assert np.exp(fit.beta[0]) == pytest.approx(rate[0]) and np.exp(fit.beta[1]) == pytest.approx(rate[1] / rate[0])


def test_rows_are_scored_by_the_fit_that_did_not_see_them(spark):
    rows = rows_of("a", 400, 1.0, 7) + rows_of("b", 300, -1.0, 8)
    df = spark.createDataFrame([*rows, ("a", 9000, None, 1.0, 1)], SCHEMA)
    folded = sampling.stratified_folds(df, ["experiment"], "converted", ["seq"], folds=3)
    got = newton.out_of_fold_scores(folded, ["experiment"], "converted", ["x", "z"], folds=3).collect()
    assert len(got) == 701
    for name in "ab":
        own = [r for r in got if r.experiment == name and r.x is not None]
        for k in range(3):
            beta = plain_logit([(name, r.seq, r.x, r.z, r.converted) for r in own if r.fold != k])
            for r in own:
                if r.fold == k:
                    assert r.score == pytest.approx(1 / (1 + np.exp(-(beta @ [1, r.x, r.z]))), abs=1e-8)
    assert [r.score for r in got if r.x is None] == [None]


def test_folds_move_no_other_column_and_run_no_job(spark):
    df = spark.range(1000).select(F.lit("x").alias("experiment"), "id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("wide").alias("feature"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("folds", "folds")
    folded = sampling.stratified_folds(df, ["experiment"], "y", ["id"]).select("id", "fold")
    sampled = sampling.fixed_size_sample(df, ["experiment"], ["id"], 100).select("id")
    assert not tracker.getJobIdsForGroup("folds")
    for plan in (folded, sampled):
        assert "wide" not in plan._jdf.queryExecution().optimizedPlan().toString()
    sizes = folded.join(df, "id").groupBy("y", "fold").count().collect()
    assert {r["count"] for r in sizes if r.y == 1} <= {66, 67} and len(sizes) == 10
    assert sampled.distinct().count() == 100


@pytest.mark.parametrize("k", [1, 7, 999, 1000, 5000])
def test_samples_are_the_least_hashes(spark, k):
    df = spark.range(2500).select(F.when(F.col("id") < 1000, "a").when(F.col("id") < 2000, F.lit(None)).otherwise("c").alias("g"), "id")
    got = sampling.fixed_size_sample(df, ["g"], ["id"], k).collect()
    hashed = df.withColumn("h", sampling.hash_number("42", F.col("id"))).collect()
    for name, size in (("a", 1000), (None, 1000), ("c", 500)):
        want = sorted((r.h, r.id) for r in hashed if r.g == name)[:k]
        assert sorted(r.id for r in got if r.g == name) == sorted(i for _, i in want)
    strict = sampling.fixed_size_sample(df, ["g"], ["id"], k, strict=True).select("g").distinct().collect()
    assert len(strict) == (3 if k <= 500 else 2 if k <= 1000 else 0)


def test_null_features_get_null_scores(spark):
    rows = rows_of("x", 300, 1.0, 4)
    df = spark.createDataFrame([(e, s, None if s % 3 == 0 else x, z, y) for e, s, x, z, y in rows], SCHEMA)
    frame = models.scoring_frame(df, ["x", "z"], "converted", ["seq"])
    for pipeline in (models.logistic("converted", ["x", "z"], ["x"]), models.logistic("converted", ["x", "z"], many_features=True)):
        scored = models.scored(models.fit(pipeline, frame), frame).collect()
        assert len(scored) == 300 and all((r.score is None) == (r.seq % 3 == 0) for r in scored)

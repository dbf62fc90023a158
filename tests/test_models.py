import math

import numpy as np
import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from armscope.operators import models, sampling


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(8)
    n = 6000
    x, t = rng.normal(0, 1, n), rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(-1 + 1.2 * x + 0.5 * t)))
    y = (rng.random(n) < p).astype(int)
    rows = [("x", i, "treatment" if a else "control", int(a), float(b), float(rng.random()), int(c))
            for i, (a, b, c) in enumerate(zip(t, x, y))]
    schema = "experiment string, user_id long, group string, is_treatment int, x double, noise double, converted int"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


def test_logit_recovers_planted_effects(planted, spec):
    rows = rows_by(models.logit_table(planted, "converted", ["x", "is_treatment"], spec), "term")
    for term, want in (("intercept", -1), ("x", 1.2), ("is_treatment", 0.5)):
        assert abs(rows[term].coef - want) < 4 * rows[term].se
    assert rows["is_treatment"].p_value < 1e-6
    assert rows["x"].odds_ratio == pytest.approx(math.exp(rows["x"].coef))
    lbfgs = models.fit(models.logistic("converted", ["x", "is_treatment"], ["x"], many_features=True),
                       models.training_frame(planted, ["x", "is_treatment"], "converted"))
    table = rows_by(models.coefficient_table(lbfgs, ["x", "is_treatment"], planted.sparkSession), "feature")
    assert table["is_treatment"].coef == pytest.approx(rows["is_treatment"].coef, abs=1e-5)


def test_rate_ratio_equals_ratio_of_rates(planted, spec):
    table = rows_by(models.poisson_table(planted, "converted", ["is_treatment"], spec), "term")
    rates = {r.group: r.m for r in planted.groupBy("group").agg(F.avg("converted").alias("m")).collect()}
    assert table["is_treatment"].rate_ratio == pytest.approx(rates["treatment"] / rates["control"])


def test_forest_ranks_the_signal_first(spark, planted):
    names = ["x", "noise", "is_treatment"]
    frame = models.with_balanced_weights(models.training_frame(planted, names, "converted"), "converted")
    model = models.fit(models.forest("converted", names, numTrees=20), frame)
    table = models.importance_table(model, names, spark).collect()
    assert table[0].feature == "x" and sum(r.importance_norm for r in table) == pytest.approx(1)
    assert {r.feature: r.kind for r in table}["is_treatment"] == "main"
    weights = frame.groupBy("converted").agg(F.sum("class_weight").alias("w")).collect()
    assert weights[0].w == pytest.approx(weights[1].w)


def test_forest_without_splits_has_zero_importances(spark):
    df = spark.range(50).select(F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("converted"))
    model = models.fit(models.forest("converted", ["x"], numTrees=2), models.with_balanced_weights(df, "converted"))
    row = models.importance_table(model, ["x"], spark).first()
    assert (row.importance, row.importance_norm) == (0.0, 0.0)


def test_boosting_and_comparison(spark, planted):
    names = ["x", "noise", "is_treatment"]
    frame = models.with_positive_weight(models.training_frame(planted, names, "converted", ["user_id"]), "converted")
    boosted = models.fit(models.boosting("converted", names, maxIter=5, maxDepth=3), frame)
    linear = models.fit(models.logistic("converted", names), frame)
    scores = models.scored(linear, models.scored(boosted, frame, "b"), "a")
    rows = rows_by(models.compare_models(scores, ["a", "b"], "converted"), "model")
    assert rows["a"].auc > 0.7 and rows["b"].auc > 0.7
    assert rows["a"].n_positive + rows["a"].n_negative == 6000


def test_held_out_folds(planted):
    names = ["x", "is_treatment"]
    frame = models.training_frame(planted, names, "converted", ["experiment", "user_id"])
    folds = sampling.stratified_folds(frame, ["experiment"], "converted", ["user_id"])
    per_fold = models.fold_aucs(models.logistic("converted", names), folds, "converted").collect()
    assert sorted(r.fold for r in per_fold) == [0, 1, 2, 3, 4]
    assert sum(r.n_positive + r.n_negative for r in per_fold) == 6000
    row = models.cross_validated_auc(models.logistic("converted", names), folds, "converted").first()
    aucs = [r.auc for r in per_fold]
    assert row.auc_mean == pytest.approx(np.mean(aucs), abs=1e-6) and row.auc_sd == pytest.approx(np.std(aucs), abs=1e-6)
    assert row.auc_min <= row.auc_mean <= row.auc_max


def test_model_covariate_reduces_variance(planted, spec):
    row = models.cuped_by_model(planted, spec, ["x", "noise"]).first()
    assert row.theta == pytest.approx(1, abs=0.05) and row.variance_reduction_pct > 10
    assert not row.covariate_pre_period


def test_uplift_deciles_follow_the_effect(spark, spec):
    rng = np.random.default_rng(3)
    n = 8000
    x, t = rng.integers(0, 2, n), rng.integers(0, 2, n)
    y = (rng.random(n) < 0.2 + 0.4 * x * t).astype(int)
    rows = [("x", "treatment" if a else "control", float(b), int(c)) for a, b, c in zip(t, x, y)]
    df = spark.createDataFrame(rows, "experiment string, group string, x double, converted int")
    out = models.uplift_deciles(models.t_learner(df, spec, ["x"], maxIter=5), spec).orderBy("decile").collect()
    assert sum(r.n_c + r.n_t for r in out) == n
    assert out[-1].observed_uplift == pytest.approx(0.4, abs=0.06) and abs(out[0].observed_uplift) < 0.06


def test_embedding_covariate(spark, spec):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (800, 4))
    y = v[:, 0] + rng.normal(0, 0.3, 800)
    rows = [("x", "control" if i % 2 else "treatment", [float(c) for c in e], float(b)) for i, (e, b) in enumerate(zip(v, y))]
    df = spark.createDataFrame(rows, "experiment string, group string, e array<float>, y double")
    row = models.cuped_by_embedding(df, spec, "e", "y", ridge=0.0).first()
    assert row.variance_reduction_pct > 80


def test_population_scaling(spark, spec):
    df = spark.createDataFrame([("x", float(i)) for i in range(10)], "experiment string, v double")
    got = [r.v_std for r in models.standardised(df, spec, ["v"]).orderBy("v").collect()]
    v = np.arange(10.0)
    assert got == pytest.approx(list((v - v.mean()) / v.std()))


def test_tree_fits_are_dealt_over_the_cores(spark, monkeypatch):
    """Small in bytes, a frame is one partition; every pass of a tree fit would then be one task."""
    few = spark.range(900).coalesce(1)
    assert models.dealt(few).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "ROWS_A_TASK", 300)
    many = models.dealt(few)
    assert many.rdd.getNumPartitions() == 3 and sorted(r.id for r in many.collect()) == list(range(900))
    assert models.dealt(spark.range(9000).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "MOST_ROWS_A_TASK", 900)
    assert models.dealt(spark.range(9000).coalesce(1)).rdd.getNumPartitions() == 10
    rows = few.select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("converted"))
    passes = []
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, data: passes.append(data.rdd.getNumPartitions()))
    models.fit(models.forest("converted", ["x"], numTrees=1), rows)
    models.fit(models.logistic("converted", ["x"]), rows)
    assert passes == [3, 1]


def test_two_learners_read_their_rows_once(spark, spec, tmp_path):
    cells = [("x", arm, float(x), y) for arm in ("control", "treatment") for x in range(4) for y in (0, 1)] * 40
    df = spark.createDataFrame(cells, "experiment string, group string, x double, converted int")
    df.write.parquet(str(tmp_path / "log"))
    out = models.t_learner(spark.read.parquet(str(tmp_path / "log")), spec, ["x"], maxIter=2)
    assert out.count() == 640 and all("/learners-" in f for f in out.inputFiles())


def test_held_out_scores_are_written(spark):
    """The ranking passes over them several times; the trees score each row once."""
    df = spark.range(400).select(
        (F.col("id") % 5).cast("int").alias("fold"), (F.col("id") % 2).cast("double").alias("converted"),
        (F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("class_weight"),
    )
    aucs = models.fold_aucs(models.forest("converted", ["x"], numTrees=2), df, "converted")
    assert sorted((r.fold, r.n_positive, r.n_negative) for r in aucs.collect()) == [(k, 40, 40) for k in range(5)]
    assert all("/held-out-" in f for f in aucs.inputFiles())

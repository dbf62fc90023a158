"""Cross-fitted predictions against plain least squares; tree tables against MLlib's own importances."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from armscope.operators import crossfit, models, trees


def rows_of(name, n, seed, weights=(1.0, 2.0, -1.0)):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2))
    y = weights[0] + x @ np.array(weights[1:]) + rng.normal(0, 1, n)
    return [(name, i, i % 3, float(v), [1.0, *map(float, u)]) for i, (u, v) in enumerate(zip(x, y))]


@pytest.mark.parametrize("ridge", [0.0, 5.0])
def test_each_fold_is_predicted_by_the_others(spark, ridge, monkeypatch):
    monkeypatch.setattr(crossfit, "_HELD", 1)
    groups = {"a": rows_of("a", 200, 1), None: rows_of(None, 90, 2, (0.0, 5.0, 0.5))}
    odd = [("a", 900, 0, None, [1.0, 2.0, 3.0]), ("a", 901, 1, 3.0, None), ("a", 902, 2, 4.0, [1.0, None, 1.0])]
    alike = [("flat", i, i % 3, float(i), [1.0, 2.0, 2.0]) for i in range(9)]
    df = spark.createDataFrame([r for rs in groups.values() for r in rs] + odd + alike, "k string, id long, fold int, y double, x array<double>")
    got = {(r.k, r.id): r.score for r in crossfit.cross_fitted(df, ["k"], "y", "x", ridge=ridge).collect()}
    assert len(got) == 302
    for name, rows in groups.items():
        for fold in range(3):
            x = np.array([r[4] for r in rows if r[2] != fold])
            y = np.array([r[3] for r in rows if r[2] != fold])
            beta = np.linalg.solve(x.T @ x + ridge * np.diag([0, 1, 1]), x.T @ y)
            for r in rows:
                if r[2] == fold:
                    assert got[name, r[1]] == pytest.approx(float(np.dot(beta, r[4])), abs=1e-9)
    assert got["a", 900] is not None and got["a", 901] is None and got["a", 902] is None
    if not ridge:
        assert {got["flat", i] for i in range(9)} == {None}  # two columns alike: no solution


def test_a_covariate_of_noise_takes_nothing_away(spark, spec):
    """Fitted in sample, forty columns of noise would seem to explain outcomes."""
    rng = np.random.default_rng(3)
    rows = [("x", i, "treatment" if i % 2 else "control", float(rng.integers(0, 2)), [float(v) for v in rng.normal(0, 1, 40)]) for i in range(400)]
    df = spark.createDataFrame(rows, "experiment string, id long, group string, y double, e array<double>")
    report = models.cuped_by_embedding(df, spec, "e", "y", ["id"]).first()
    assert report.variance_reduction_pct < 2 and report.covariate_pre_period is False


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(c), float(rng.random() < 0.2 + 0.5 * a)) for a, b, c in zip(rng.integers(0, 2, 3000), rng.normal(0, 1, 3000), rng.normal(0, 1, 3000))]
    return spark.createDataFrame(rows, "a double, b double, c double, converted double")


NAMES = ["a", "b", "c", "idle"]


@pytest.mark.parametrize("kind", ["forest", "boosting"])
def test_importances_agree_with_mllib(spark, frame, kind):
    df = frame.withColumn("idle", F.lit(1.0))
    if kind == "forest":
        model = models.fit(models.forest("converted", NAMES, numTrees=12, maxDepth=4), models.with_balanced_weights(df, "converted"))
    else:
        model = models.fit(models.boosting("converted", NAMES, maxIter=8, maxDepth=3), models.with_positive_weight(df, "converted"))
    fitted = model.stages[-1]
    nodes = trees.tree_nodes(fitted, spark, NAMES)
    table = {r.feature: r for r in trees.node_importances(nodes, NAMES, kind == "forest").collect()}
    want = fitted.featureImportances.toArray()
    assert [table[n].importance for n in NAMES] == pytest.approx(list(want), abs=1e-9)
    assert table["idle"].splits == 0 and table["idle"].gain_per_split is None
    assert table["a"].importance_rank == 1
    inner = nodes.where("feature is not null").collect()
    weights = {(r.tree, r.node): r.weight for r in nodes.collect()}
    assert all(r.weight == pytest.approx(weights[r.tree, r.left] + weights[r.tree, r.right]) for r in inner)


def test_an_ensemble_without_splits(spark):
    df = models.with_balanced_weights(spark.range(50).select(F.lit(1.0).alias("x"), (F.col("id") % 2).cast("double").alias("converted")), "converted")
    fitted = models.fit(models.forest("converted", ["x"], numTrees=2), df).stages[-1]
    row = trees.node_importances(trees.tree_nodes(fitted, spark, ["x"]), ["x"], True).first()
    assert (row.importance, row.splits, row.importance_rank) == (0.0, 0, 1)


def test_linear_uplift_of_two_treatments(spark, spec):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(3000):
        x, arm = float(rng.normal()), ("control", "blue", "green")[i % 3]
        lift = {"control": 0.0, "blue": 2.0 * x, "green": 1.0}[arm]
        rows.append(("e" if i % 2 else None, arm, None if i % 100 == 7 else x, float(1 + x + lift + rng.normal(0, 0.1))))
    df = spark.createDataFrame(rows, "experiment string, `group` string, x double, converted double")
    three = replace(spec, treatments=("blue", "green"))
    scored = models.linear_uplift(df, three, ["x"])
    assert scored.count() == 4000  # the control's rows stand in both comparisons
    deciles = models.exact_uplift_deciles(scored, three).collect()
    assert {(r.experiment, r.treatment) for r in deciles} == {(e, t) for e in ("e", None) for t in ("blue", "green")}
    for e in ("e", None):
        blue = sorted((r.decile, r.predicted_uplift, r.observed_uplift, r.n_c + r.n_t) for r in deciles if r.treatment == "blue" and r.experiment == e)
        assert [d for d, *_ in blue] == list(range(1, 11)) and all(abs(p - o) < 0.2 for _, p, o, _ in blue)
        assert blue[0][1] < -2 and blue[-1][1] > 2 and max(n for *_, n in blue) - min(n for *_, n in blue) <= 1

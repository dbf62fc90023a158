"""Trees grown from counts of equal binned rows, against MLlib's own on the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armscope.operators import cells, models, trees

NAMES = ["a", "t", "c", "idle", "a_t"]
FIXED = {"minInstancesPerNode": 20, "featureSubsetStrategy": "all", "subsamplingRate": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    """Few values of each column, so that MLlib's cut points and these are the same."""
    rng = np.random.default_rng(5)
    n = 4000
    a, t, c = rng.integers(0, 2, n), rng.integers(0, 60, n), rng.integers(0, 4, n)
    y = rng.random(n) < 0.2 + 0.25 * a + 0.006 * t * (c == 2) - 0.1 * (t > 40)
    frame = pd.DataFrame({"a": a, "t": t, "c": c, "idle": 1, "a_t": a * t, "converted": y, "fold": np.arange(n) % 3}).astype(float)
    return spark.createDataFrame(frame).withColumn("fold", F.col("fold").cast("int")).cache()


def planned(kind, rows, **settings):
    if kind == "forest":
        return models.forest("converted", NAMES, **{"maxDepth": 5, **settings}), models.with_balanced_weights(rows, "converted")
    return models.boosting("converted", NAMES, **{"maxDepth": 3, **settings}), models.with_positive_weight(rows, "converted")


def largest_difference(one, other, rows):
    both = models.scored(other, models.scored(one, rows, "one"), "other")
    return both.select(F.max(F.abs(F.col("one") - F.col("other")))).first()[0]


@pytest.mark.parametrize("kind,settings", [("forest", {"numTrees": 1, "bootstrap": False}), ("boosting", {"maxIter": 5})])
def test_the_trees_are_mllibs_where_nothing_is_drawn(spark, rows, kind, settings):
    plan, train = planned(kind, rows, **FIXED, **settings)
    want = plan.fit(train)
    (got,) = cells.ensembles(plan, train)
    assert largest_difference(want, got, rows) < 1e-9
    a, b = ({(r.tree, r.node): r for r in trees.tree_nodes(m.stages[-1], spark, NAMES).collect()} for m in (want, got))
    assert a.keys() == b.keys() and len(a) > 15
    for key, node in a.items():
        assert (node.n, node.left, node.right) == (b[key].n, b[key].left, b[key].right)
        assert node.gain == pytest.approx(b[key].gain, abs=1e-9) and node.weight == pytest.approx(b[key].weight)
    assert got.stages[-1].extractParamMap() == want.stages[-1].extractParamMap()


def test_each_fold_has_the_trees_of_the_others(rows):
    plan, train = planned("boosting", rows, maxIter=3, **FIXED)
    fitted = cells.ensembles(plan, train, "fold", 3)
    assert len(fitted) == 3
    for k in (0, 2):
        assert largest_difference(plan.fit(train.where(F.col("fold") != k)), fitted[k], rows) < 1e-9


def test_rows_are_read_a_few_times_however_many_trees(spark, rows, monkeypatch):
    """MLlib reads them at every level of every tree: 30 rounds of 3 levels are over 150 jobs."""
    monkeypatch.setattr(cells, "ROWS_FROM", 1000)
    plan, train = planned("boosting", rows, maxIter=30)
    context = spark.sparkContext

    def jobs(name, work):
        context.setJobGroup(name, name)
        work()
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(name))

    assert jobs("one fit", lambda: models.fit(plan, train)) < 50
    assert jobs("folds", lambda: models.fold_aucs(plan, train, "converted", folds=3).collect()) < 100


def test_folds_of_many_rows_are_scored_by_the_others(rows, monkeypatch):
    plan, train = planned("forest", rows, numTrees=1, bootstrap=False, **FIXED)
    want = {r.fold: r for r in models.fold_aucs(plan, train, "converted", folds=3).collect()}
    monkeypatch.setattr(cells, "ROWS_FROM", 1000)
    monkeypatch.setattr(models.Pipeline, "fit", None)
    got = {r.fold: r for r in models.fold_aucs(plan, train, "converted", folds=3).collect()}
    assert {k: (r.n_positive, r.n_negative) for k, r in got.items()} == {k: (r.n_positive, r.n_negative) for k, r in want.items()}
    # leaves that agree but for the last digits rank either way
    assert [got[k].auc for k in range(3)] == pytest.approx([want[k].auc for k in range(3)], abs=1e-3)


def test_drawn_rows_follow_their_law_and_no_partitioning(spark, rows):
    n = rows.count()
    for kind, settings, mean, sd in (("forest", {"numTrees": 30}, n, n**0.5), ("boosting", {"maxIter": 30}, 0.8 * n, (0.16 * n) ** 0.5)):
        plan, train = planned(kind, rows, minInstancesPerNode=20, **settings)
        one, other = (
            sorted(tuple(r) for r in trees.tree_nodes(cells.ensembles(plan, d)[0].stages[-1], spark, NAMES).drop("feature", "threshold").fillna(-1.0).collect())
            for d in (train.coalesce(1), train.repartition(5))
        )
        assert one == other
        taken = [r[4] for r in one if r[1] == 0]
        assert len(set(taken)) > 15 and all(abs(v - mean) < 5 * sd for v in taken) and abs(np.mean(taken) - mean) < 5 * sd / 30**0.5


def test_cut_points_part_the_weight_evenly_whatever_the_scale(spark):
    """Neither far values nor half of the rows at zero spoil them."""
    rng = np.random.default_rng(2)
    far = np.concatenate([1e6 + np.exp(rng.normal(0, 1, 30000)) / 1e3, [-1e12, 1e15]])
    half = np.where(np.arange(30002) % 2, rng.random(30002), 0.0)
    frame = spark.createDataFrame(pd.DataFrame({"_0": far, "_1": half, "_2": 3.0, "_w": 1.0 + np.arange(30002) % 2, "_f": -1})).repartition(3)
    weights, values = cells._value_counts(frame, 3, 32)
    assert list(weights) == [1.0, 2.0]
    w = 1.0 + np.arange(30002) % 2
    for x, v in ((far, values[0]), (half, values[1])):
        cuts = cells._cut_points(v, None, 32)
        shares = np.bincount(np.searchsorted(cuts, x), w, len(cuts) + 1) / w.sum()
        # zero is a third of the weight in one value: by MLlib's rule the next ten cuts follow at once
        assert len(shares) >= 30 and all(0.028 < s < 0.035 for s in (shares if x is far else shares[12:])[:-1])
    assert len(cells._cut_points(values[2], None, 32)) == 0


def test_other_rows_and_settings_are_left_to_mllib(spark, rows, monkeypatch):
    plan, train = planned("forest", rows, numTrees=2)
    assert cells.ensembles(plan, train.withColumn("class_weight", F.rand(1))) is None
    assert cells.ensembles(plan, train.withColumn("converted", F.col("c"))) is None
    assert cells.ensembles(plan, train.withColumn("converted", F.lit(1.0))) is None
    assert cells.ensembles(plan, train.withColumn("t", F.lit(float("inf")))) is None
    assert not cells.suits(models.forest("converted", NAMES, impurity="entropy")) and not cells.suits(models.logistic("converted", NAMES))
    monkeypatch.setattr(cells, "MOST_CELLS", 100)
    monkeypatch.setattr(cells, "ROWS_FROM", 1000)
    assert cells.ensembles(plan, train) is None
    assert models.fit(plan, train).stages[-1].getNumTrees == 2

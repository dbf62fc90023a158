import math

import numpy as np
import pytest
from conftest import rows_by
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from armscope.operators import means, ranks, sampling


def mid_ranks(values):
    order = np.sort(values)
    low, high = np.searchsorted(order, values, "left"), np.searchsorted(order, values, "right")
    return (low + high + 1) / 2


def brute_rank_sum(a, b):
    both = np.concatenate([a, b])
    n1, n2, n = len(a), len(b), len(both)
    u = mid_ranks(both)[:n1].sum() - n1 * (n1 + 1) / 2
    _, ties = np.unique(both, return_counts=True)
    sigma2 = n1 * n2 / 12 * ((n + 1) - (ties**3 - ties).sum() / (n * (n - 1)))
    if sigma2 <= 0:
        return u, None
    z = max(abs(u - n1 * n2 / 2) - 0.5, 0) / math.sqrt(sigma2)
    return u, min(math.erfc(z / math.sqrt(2)), 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "experiment string, group string, time_seconds double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.booleans(), st.integers(0, 6)), min_size=4, max_size=60).filter(
        lambda v: len({a for a, _ in v}) == 2
    )
)
def test_mann_whitney_matches_brute_force(spark, spec, drawn):
    rows = [("x", "control" if a else "treatment", float(v)) for a, v in drawn]
    a = np.array([v for arm, v in drawn if arm], float)
    b = np.array([v for arm, v in drawn if not arm], float)
    u, p = brute_rank_sum(a, b)
    row = ranks.mann_whitney(frame(spark, rows), spec).first()
    assert row.u == pytest.approx(u)
    assert row.p_value is None if p is None else row.p_value == pytest.approx(p)


def test_all_equal_values_have_no_z(spark, spec):
    row = ranks.mann_whitney(frame(spark, [("x", "control", 1.0)] * 10 + [("x", "treatment", 1.0)] * 10), spec).first()
    assert row.u == 50 and row.z is None and row.p_value is None


def test_groups_with_a_dominant_one(spark, spec):
    rng = np.random.default_rng(0)
    rows = [("big" if i % 4 else f"s{i % 12}", "control" if rng.random() < 0.5 else "treatment", float(v))
            for i, v in enumerate(np.round(rng.normal(0, 50, 4000)))]
    got = rows_by(ranks.mann_whitney(frame(spark, rows), spec), "experiment")
    for name, row in got.items():
        a = np.array([r[2] for r in rows if r[0] == name and r[1] == "control"])
        b = np.array([r[2] for r in rows if r[0] == name and r[1] == "treatment"])
        u, p = brute_rank_sum(a, b)
        assert row.u == pytest.approx(u) and row.p_value == pytest.approx(p)


@pytest.mark.parametrize("slices", [1, 2, 13])
def test_running_sums_for_any_number_of_slices(spark, slices):
    rows = [("g" if i % 3 else None, i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    got = ranks.running_sums(df, ["g"], ["k"], ["n"], slices=slices).collect()
    for r in got:
        mine = [row for row in rows if row[0] == r.g]
        assert r.n_before == sum(row[2] for row in mine if row[1] < r.k)
        assert r.n_total == sum(row[2] for row in mine)
    assert len(got) == len(rows)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    values = {"a": rng.exponential(10, 501), "b": np.round(rng.normal(0, 2, 300)), "c": np.array([4.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = rows_by(ranks.quantiles(df, ["g"], "v", {"q10": 0.1, "q50": 0.5, "q99": 0.99, "q0": 0.0, "q100": 1.0}), "g")
    for g, vs in values.items():
        for name, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99), ("q0", 0), ("q100", 1)):
            assert got[g][name] == pytest.approx(np.quantile(vs, q))


def test_auc_counts_pairs(spark):
    rng = np.random.default_rng(9)
    score, label = np.round(rng.random(200), 1), rng.integers(0, 2, 200)
    df = spark.createDataFrame([("x", float(s), int(y)) for s, y in zip(score, label)], "e string, s double, y int")
    pairs = [(a > b) + 0.5 * (a == b) for a in score[label == 1] for b in score[label == 0]]
    assert ranks.auc(df, ["e"], "s", "y").first().auc == pytest.approx(np.mean(pairs))


def test_ks_distance(spark, spec):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(10, 3, 500), 1)
    df = frame(spark, [("x", "control", float(x)) for x in v])
    row = ranks.normality(df, spec).first()
    s = np.sort(v)
    law = np.array([0.5 * math.erfc(-(x - v.mean()) / v.std(ddof=1) / math.sqrt(2)) for x in s])
    above = np.searchsorted(s, s, "right") / len(s) - law
    below = law - np.searchsorted(s, s, "left") / len(s)
    assert row.ks == pytest.approx(max(np.abs(above).max(), np.abs(below).max()))
    assert row.normal


def test_describe_and_distinct(spark):
    df = spark.createDataFrame([("x", float(v)) for v in [1, 2, 2, 3, 10]], "g string, v double")
    row = ranks.describe(df, ["g"], "v").first()
    assert (row.n, row["min"], row.q25, row.q50, row.q75, row["max"]) == (5, 1, 2, 2, 3, 10)
    assert ranks.distinct_counts(df, ["g"], "v").first().n_distinct == 4
    near = ranks.approximate_quantiles(df, ["g"], "v", {"m": 0.5}).first()
    assert near.m == 2


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(9000).withColumn("g", F.when(F.col("id") % 10 < 8, "big").otherwise("small"))
    def draw(d):
        return {r.id for r in sampling.fixed_size_sample(d, ["g"], ["id"], 500).collect()}

    first = draw(df)
    assert len(first) == 1000 and first == draw(df.repartition(17))
    assert first != {r.id for r in sampling.fixed_size_sample(df, ["g"], ["id"], 500, seed=1).collect()}


def test_sample_takes_the_smallest_hashes(spark):
    from armscope.functions.hashing import hash_number

    df = spark.range(3000).withColumn("g", F.lit("x"))
    hashes = {r.id: r.h for r in df.select("id", hash_number("42", F.col("id")).alias("h")).collect()}
    got = {r.id for r in sampling.fixed_size_sample(df, ["g"], ["id"], 700).collect()}
    assert got == set(sorted(hashes, key=lambda i: (hashes[i], i))[:700])


def test_small_groups_give_all_or_nothing(spark):
    df = spark.range(30).withColumn("g", F.when(F.col("id") < 5, "few").otherwise("many"))
    got = sampling.fixed_size_sample(df, ["g"], ["id"], 20).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"few": 5, "many": 20}
    strict = sampling.fixed_size_sample(df, ["g"], ["id"], 20, strict=True).select("g").distinct().collect()
    assert [r.g for r in strict] == ["many"]


def test_folds_are_level_within_classes(spark):
    df = spark.range(1003).withColumns({"e": F.lit("x"), "y": (F.col("id") % 9 == 0).cast("int")})
    counts = sampling.stratified_folds(df, ["e"], "y", ["id"]).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r.y == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = sampling.stratified_folds(df.repartition(11), ["e"], "y", ["id"])
    first = {r.id: r.fold for r in sampling.stratified_folds(df, ["e"], "y", ["id"]).collect()}
    assert first == {r.id: r.fold for r in again.collect()}


def test_poststratification_weights(spark):
    df = spark.range(1000).withColumns({"e": F.lit("x"), "s": F.when(F.col("id") % 4 == 0, "a").otherwise("b")})
    sample = sampling.stratified_sample(df, ["e"], "s", ["id"], 100)
    rows = rows_by(sampling.poststratification_weights(sample, df, ["e"], "s"), "s")
    assert rows["a"].weight == pytest.approx(0.5) and rows["b"].weight == pytest.approx(1.5)


def test_no_job_runs_before_the_action(spark, spec):
    df = spark.range(500).select(
        F.lit("x").alias("experiment"), F.when(F.col("id") % 2 == 0, "control").otherwise("treatment").alias("group"),
        (F.col("id") % 37).cast("double").alias("time_seconds"),
    )
    spark.sparkContext.setJobGroup("ranks", "ranks")
    for plan in (ranks.mann_whitney(df, spec), ranks.normality(df, spec), ranks.describe(df, ["group"], "time_seconds")):
        assert plan.columns
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("ranks")


@pytest.mark.parametrize("slices", [1, 2, 7, 50])
def test_running_sums_for_any_number_of_slices(spark, slices):
    values = [("a", float(v), v % 4) for v in range(-40, 60, 3)] + [(None, v / 8, 1) for v in range(30)] + [("a", None, 5), ("c", None, 0)]
    df = spark.createDataFrame(values, "g string, value double, c int")
    got = ranks.running_sums(df, ["g"], "value", ["c"], slices).collect()
    assert len(got) == len(values)
    for r in got:
        own = [(v, c) for g, v, c in values if g == r.g]
        assert r.c_total == sum(c for _, c in own)
        assert r.c_before == sum(c for v, c in own if r.value is not None and (v is None or v < r.value))


def test_groups_of_nulls_stay(spark, spec):
    rows = [("x", "control", None), ("x", "control", None), ("x", "treatment", 5.0), ("x", "treatment", 7.0)]
    df = spark.createDataFrame(rows, "experiment string, group string, time_seconds double")
    found = {r.group: r for r in ranks.describe(df, ["group"], "time_seconds").collect()}
    assert (found["control"].n, found["control"].mean, found["control"].q50) == (0, None, None)
    assert (found["treatment"].n, found["treatment"].q50, found["treatment"].mean) == (2, 6.0, 6.0)
    places = {r.arm: r for r in means.location_summary(df, spec).collect()}
    assert places["control"].n == 0 and places["treatment"].median_s == 6.0


def test_a_large_mean_keeps_a_small_spread(spark):
    df = spark.range(1000).select(F.lit("a").alias("g"), (1e9 + F.col("id") % 2).alias("v"))
    row = ranks.describe(df, ["g"], "v").first()
    assert row.sd == pytest.approx(0.5002501876563868, rel=1e-9)

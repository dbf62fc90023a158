import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from armscope.operators import design, multiple, power, timeline, variance
from armscope.operators.multiple import Metric


def test_known_sample_sizes(spec):
    got = [power.sample_size_for(0.12, m, spec) for m in (0.01, 0.02, 0.05, 0.10)]
    # Whole numbers of the exact two-sided root; the closed form differs by a few millionths.
    assert got == pytest.approx([1156127, 290267, 47030, 11999], rel=5e-6, abs=1)


def test_sample_size_table(units, spec):
    df = units([("control", "US", 1, 12), ("control", "US", 0, 88), ("treatment", "US", 0, 50)])
    base = power.baselines(df, spec)
    assert base.first().current_n == 50
    rows = rows_by(power.sample_sizes(base, spec), "mde")
    assert rows[0.01].n_required == pytest.approx(1156129, abs=1)
    assert rows[0.05].shortfall == pytest.approx(47030 / 50, rel=1e-4)
    curve = power.power_curve(base, spec).orderBy("n").collect()
    assert len(curve) == 100 and curve[0].n == 10000 and curve[-1].n == pytest.approx(2000000)
    assert all(a.power < b.power for a, b in itertools.pairwise(curve))
    near = min(curve, key=lambda r: abs(r.n - r.n_required))
    assert near.power == pytest.approx(0.8, abs=0.01)


def test_impossible_effect_has_no_size(units, spec):
    base = power.baselines(units([("control", "US", 1, 10), ("treatment", "US", 1, 10)]), spec)
    assert all(r.n_required is None for r in power.sample_sizes(base, spec).collect())


def test_duration_in_whole_weeks(spark, units, spec):
    df = units([("control", "US", 1, 500), ("control", "US", 0, 500), ("treatment", "US", 0, 1000)])
    log = df.withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("user_id") % 4).cast("int")))
    row = power.duration_days(log, power.baselines(df, spec), spec, mde=0.1).first()
    assert row.daily_units == 500
    assert row.min_days == math.ceil(row.n_required * 2 / 500)
    assert row.planned_days % 7 == 0 and row.planned_days >= max(7, row.min_days)


@pytest.fixture
def prepost(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(50, 10, n)
    t = rng.integers(0, 2, n)
    y = 2 * x + 3 * t + rng.normal(0, 5, n)
    rows = [("x", i, "treatment" if a else "control", float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, x, y))]
    return spark.createDataFrame(rows, "experiment string, user_id long, group string, pre double, post double"), x, t, y


def test_cuped_matches_numpy(prepost, spec):
    df, x, t, y = prepost
    theta = np.cov(y, x)[0, 1] / np.var(x)
    adj = y - theta * (x - x.mean())
    row = variance.cuped_report(df, spec, "post", "pre").first()
    assert row.theta == pytest.approx(theta)
    assert row.var_original == pytest.approx(y.var()) and row.var_adjusted == pytest.approx(adj.var())
    se = math.sqrt(adj[t == 0].var() / (t == 0).sum() + adj[t == 1].var() / (t == 1).sum())
    assert row.se_adj == pytest.approx(se)
    assert row.z_adj == pytest.approx((adj[t == 0].mean() - adj[t == 1].mean()) / se)
    assert row.variance_reduction_pct > 90 and abs(row.z_adj) > abs(row.z)
    rows = {r.user_id: r.y_adj for r in variance.cuped_adjust(df, spec, "post", "pre").collect()}
    assert [rows[i] for i in range(len(y))] == pytest.approx(list(adj))


def test_constant_covariate_adjusts_nothing(prepost, spec):
    df = prepost[0].withColumn("pre", F.lit(1.0))
    row = variance.cuped_report(df, spec, "post", "pre").first()
    assert row.theta is None and row.var_adjusted is None and row.variance_reduction_pct is None


def test_ancova_matches_least_squares(prepost, spec):
    df, x, t, y = prepost
    design_matrix = np.column_stack([np.ones_like(x), t, x])
    beta, rss, *_ = np.linalg.lstsq(design_matrix, y, rcond=None)
    cov = rss[0] / (len(y) - 3) * np.linalg.inv(design_matrix.T @ design_matrix)
    row = variance.ancova(df, spec, "post", "pre").first()
    assert (row.effect, row.slope) == (pytest.approx(beta[1]), pytest.approx(beta[2]))
    assert row.se == pytest.approx(math.sqrt(cov[1, 1]))
    assert row.p_value < 1e-6


def test_sample_ratio_alarm(units, spec):
    skewed = units([("control", "US", 0, 600), ("treatment", "US", 0, 400)])
    row = design.sample_ratio(skewed, spec).first()
    assert row.chi2 == pytest.approx(40) and row.mismatch_alarm
    planned = design.sample_ratio(skewed, spec, {"control": 60, "treatment": 40}).first()
    assert planned.chi2 == pytest.approx(0) and not planned.mismatch_alarm


def test_stratum_balance_by_hand(units, spec):
    df = units([("control", "US", 0, 30), ("treatment", "US", 0, 20), ("control", "UK", 0, 10), ("treatment", "UK", 0, 40)])
    row = design.stratum_balance(df, spec).first()
    observed = np.array([[30, 20], [10, 40]])
    expected = observed.sum(1, keepdims=True) * observed.sum(0) / observed.sum()
    assert row.chi2 == pytest.approx(((observed - expected) ** 2 / expected).sum()) and row.df == 1


def test_aa_replicates_are_calibrated(spark, spec):
    df = spark.range(4000).select(
        F.lit("x").alias("experiment"), F.col("id").alias("user_id"), (F.col("id") % 7 == 0).cast("int").alias("converted")
    )
    summary = design.aa_summary(design.aa_replicates(df, spec, [f"s{i}" for i in range(100)]), spec).first()
    assert summary.n_replicates == 100 and summary.false_positive_rate <= 0.12


def test_layers(spark):
    units = spark.range(20000)
    rows = design.layer_independence(units, "id", ["a", "b", "c"]).collect()
    assert len(rows) == 3 and all(r.df == 1 and r.p_value > 0.001 for r in rows)
    same = design.contingency_chi_square(
        spark.createDataFrame([("g", "x", "x", 50), ("g", "y", "y", 50)], "g string, a string, b string, n long"),
        ["g"], "a", "b").first()
    assert same.chi2 == pytest.approx(100)


def test_boundary_units(spark, spec):
    df = spark.createDataFrame(
        [("x", 1, "treatment", 1), ("x", 2, "control", 0), ("x", 3, "treatment", 0), ("x", 4, "treatment", 1), ("x", 5, "control", 1)],
        "experiment string, user_id long, group string, converted int")
    edges = spark.createDataFrame([(1, 2), (3, 4), (1, 3), (9, 1)], "src long, dst long")
    got = rows_by(design.spillover_boundary(df, edges, spec), "arm", "position")
    assert got["treatment", "boundary"].n == 1 and got["treatment", "core"].n == 2
    assert got["control", "boundary"].n == 1 and got["control", "core"].n == 1
    assert got["treatment", "core"]["mean"] == 0.5


def test_cluster_effect_uses_cluster_means(spark, units, spec):
    df = units([("control", "US", 1, 50), ("treatment", "US", 0, 150)])
    clusters = df.select("user_id", (F.col("user_id") % 10).alias("cluster"))
    row = design.cluster_effect(df, clusters, spec, "salt").first()
    assert row.n_c + row.n_t == 10


def test_interleaving(spark, spec):
    rows = [("x", u, "A") for u in range(10) for _ in range(3)] + [("x", u, "B") for u in range(10) for _ in range(1 + u % 2)]
    df = spark.createDataFrame(rows, "experiment string, user_id long, list string")
    row = design.interleaving(df, spec, "list", "A", "B").first()
    d = np.array([3 - 1 - u % 2 for u in range(10)])
    assert (row.wins_first, row.wins_second) == (10, 0)
    assert row.z == pytest.approx(d.mean() / d.std(ddof=1) * math.sqrt(10)) and row.sign_z == pytest.approx(math.sqrt(10))


def test_corrections_match_brute_force(spark):
    rng = np.random.default_rng(1)
    p = {g: rng.random(n) ** 3 for g, n in (("a", 20), ("b", 7))}
    rows = [(g, f"h{i}", float(v)) for g, ps in p.items() for i, v in enumerate(ps)] + [("a", "none", None)]
    df = spark.createDataFrame(rows, "g string, h string, p_value double")
    out = multiple.correct_p_values(df, ["g"], order=["h"]).collect()
    assert len(out) == 27
    for g, ps in p.items():
        order = np.argsort(ps)
        adjusted = np.minimum.accumulate((np.sort(ps) * len(ps) / np.arange(1, len(ps) + 1))[::-1])[::-1]
        want = dict(zip(order, np.minimum(adjusted, 1)))
        for r in (r for r in out if r.g == g):
            i = int(r.h[1:])
            assert r.p_bh == pytest.approx(want[i])
            assert r.p_bonferroni == pytest.approx(min(1, ps[i] * len(ps)))
            assert r.family_error == pytest.approx(1 - 0.95 ** len(ps))


def test_metric_tests_in_one_scan(prepost, spec):
    df, x, t, y = prepost
    rows = rows_by(multiple.metric_tests(df, spec, [Metric("a", "post", "primary"), Metric("b", "pre", "guardrail", -1)]), "metric")
    assert rows["a"].effect == pytest.approx(y[t == 1].mean() - y[t == 0].mean())
    assert rows["b"].role == "guardrail" and rows["b"].good == -1
    assert rows["a"].ci_low < rows["a"].effect < rows["a"].ci_high


def test_quasi_poisson(spark, spec):
    rng = np.random.default_rng(4)
    y, t = rng.negative_binomial(2, 0.2, 500), rng.integers(0, 2, 500)
    df = spark.createDataFrame([("x", "treatment" if a else "control", int(b)) for a, b in zip(t, y)],
                               "experiment string, group string, n int")
    row = multiple.quasi_poisson(df, spec, "n").first()
    m = np.where(t == 1, y[t == 1].mean(), y[t == 0].mean())
    assert row.dispersion == pytest.approx(((y - m) ** 2 / m).sum() / 498) and row.dispersion > 2
    assert row.se_log == pytest.approx(row.se_log_poisson * math.sqrt(row.dispersion))
    assert row.rate_ratio == pytest.approx(y[t == 1].mean() / y[t == 0].mean())


@pytest.fixture
def dated(spark):
    rows = []
    for u in range(40):
        for d in range(u % 3, 6):
            rows.append(("x", u, "control" if u % 2 else "treatment", f"2024-01-{1 + d:02d} 05:00:00", int((u + d) % 4 == 0)))
    df = spark.createDataFrame(rows, "experiment string, user_id long, group string, ts string, converted int")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), rows


def test_lift_by_exposure_day(dated, spec):
    df, rows = dated
    got = rows_by(timeline.lift_by_exposure_day(df, spec), "exposure_day")
    for day in range(6):
        mine = [r for r in rows if int(r[3][8:10]) - 1 - r[1] % 3 == day]
        c = [r[4] for r in mine if r[2] == "control"]
        t = [r[4] for r in mine if r[2] == "treatment"]
        assert (got[day].n_c, got[day].n_t) == (len(c), len(t))
        assert got[day].lift_pp == pytest.approx((np.mean(t) - np.mean(c)) * 100)


def test_peeking_guard(dated, spec):
    df, rows = dated
    out = sorted(timeline.peeking_guard(df, spec, planned_n=50).collect(), key=lambda r: r.day)
    assert [r.n_c for r in out] == list(np.cumsum([sum(1 for r in rows if r[2] == "control" and r[3][8:10] == f"{d:02d}") for d in range(1, 7)]))
    verdicts = [r.fixed_horizon_verdict for r in out]
    first = next(i for i, r in enumerate(out) if min(r.n_c, r.n_t) >= 50)
    assert verdicts[first] is not None and [v for v in verdicts if v] == [verdicts[first]]
    stopped = [r.peeker_stopped for r in out]
    assert stopped == sorted(stopped)


def test_a_thousand_layers(spark):
    units = spark.range(400).withColumnRenamed("id", "u")
    salts = [f"s{i}" for i in range(1000)] + ["s0 again"]
    table = design.layer_independence(units, "u", salts[:1000])
    assert table.count() == 1000 * 999 // 2
    assert 0.03 < table.where("p_value < 0.05").count() / table.count() < 0.07
    row = design.layer_independence(units.unionByName(units), "u", ["a", "b"]).first()
    arms = [(hashlib.md5(f"a:{u}".encode()).hexdigest(), hashlib.md5(f"b:{u}".encode()).hexdigest()) for u in range(400)]
    cells = Counter((int(a[:8], 16) % 2, int(b[:8], 16) % 2) for a, b in arms for _ in range(2))
    n = 800
    want = n * (cells[0, 0] * cells[1, 1] - cells[0, 1] * cells[1, 0]) ** 2
    for side in (0, 1):
        want /= sum(v for k, v in cells.items() if k[0] == side) * sum(v for k, v in cells.items() if k[1] == side)
    assert row.chi2 == pytest.approx(want) and (row.n, row.df) == (800, 1)


def test_planned_shares_lengthen_the_run(spark, units, spec):
    from dataclasses import replace

    df = units([("control", "A", 1, 300), ("control", "A", 0, 700), ("treatment", "A", 1, 300), ("treatment", "A", 0, 700)])
    log = df.withColumn("ts", F.lit("2024-01-01").cast("date"))
    days = {}
    for shares in ((0.5, 0.5), (0.9, 0.1)):
        own = replace(spec, shares=shares)
        days[shares] = power.duration_days(log, power.baselines(df, own), own, 0.05).first()
    even, split = days[0.5, 0.5], days[0.9, 0.1]
    assert even.n_control == pytest.approx(even.n_required) == pytest.approx(power.sample_size_for(0.3, 0.05, spec))
    assert split.n_control == pytest.approx(9 * split.n_required)
    assert split.min_days > 2 * even.min_days

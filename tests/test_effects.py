import math
from dataclasses import replace

import numpy as np
import pytest
from conftest import rows_by
from pyspark.sql import functions as F

from armscope.operators import distribution, means, proportions, summaries

CELLS = [("control", "US", 1, 30), ("control", "US", 0, 170), ("treatment", "US", 1, 45), ("treatment", "US", 0, 155)]


def test_two_proportion_z_by_hand(units, spec):
    row = proportions.two_proportion_z(units(CELLS), spec).first()
    p1, p2, pool = 30 / 200, 45 / 200, 75 / 400
    z = (p1 - p2) / math.sqrt(pool * (1 - pool) * (2 / 200))
    half = 1.96 * math.sqrt(p1 * (1 - p1) / 200 + p2 * (1 - p2) / 200)
    assert row.z == pytest.approx(z)
    assert row.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert (row.ci_low, row.ci_high) == (pytest.approx(p1 - p2 - half), pytest.approx(p1 - p2 + half))
    # The upper bound is 0.109 points, just above the negligible 0.1.
    assert row.verdict == "not_significant" and not row.negligible


def test_chi_square_is_z_squared(units, spec):
    df = units(CELLS)
    z = proportions.two_proportion_z(df, spec).first()
    chi = proportions.chi_square_2x2(df, spec).first()
    assert chi.chi2 == pytest.approx(z.z**2)
    assert chi.p_value == pytest.approx(z.p_value)


def test_swapping_arms_flips_z(units, spec):
    df = units(CELLS)
    other = df.withColumn("group", F.when(F.col("group") == "control", "treatment").otherwise("control"))
    a, b = (proportions.two_proportion_z(d, spec).first() for d in (df, other))
    assert a.z == pytest.approx(-b.z) and a.p_value == pytest.approx(b.p_value)


def test_doubling_the_data_scales_z(units, spec):
    df = units(CELLS)
    a, b = (proportions.two_proportion_z(d, spec).first() for d in (df, df.unionAll(df)))
    assert b.z == pytest.approx(a.z * math.sqrt(2))


def test_partitioning_changes_nothing(units, spec):
    df = units(CELLS)
    a, b = (proportions.two_proportion_z(d, spec).first() for d in (df.repartition(1), df.repartition(9)))
    assert a == b


def test_empty_arm_gives_null(units, spec):
    row = proportions.two_proportion_z(units([("control", "US", 1, 5)]), spec).first()
    assert row.n_t == 0 and row.z is None and row.p_value is None and row.verdict is None


def test_no_conversions_gives_null_z(units, spec):
    row = proportions.two_proportion_z(units([("control", "US", 0, 5), ("treatment", "US", 0, 5)]), spec).first()
    assert row.z is None and row.diff == 0 and row.direction == "treatment_higher"


def test_null_metric_is_not_counted(spark, spec):
    rows = [("x", 1, "control", 1), ("x", 2, "control", None), ("x", 3, "treatment", 0)]
    df = spark.createDataFrame(rows, "experiment string, user_id long, group string, converted int")
    row = proportions.two_proportion_z(df, spec).first()
    assert (row.n_c, row.p_c) == (1, 1.0)


def test_several_treatments(spark, spec):
    from dataclasses import replace

    spec = replace(spec, treatments=("b", "c"), arm_pages={"control": "p0", "b": "p1", "c": "p2"})
    rows = [("x", i, arm, int(i % k == 0)) for arm, k in (("control", 2), ("b", 3), ("c", 4)) for i in range(120)]
    df = spark.createDataFrame(rows, "experiment string, user_id long, group string, converted int")
    got = rows_by(proportions.two_proportion_z(df, spec), "treatment")
    assert got["b"].p_t == pytest.approx(1 / 3) and got["c"].p_t == pytest.approx(1 / 4)


REVERSAL = [
    ("control", "US", 1, 80), ("control", "US", 0, 20), ("treatment", "US", 1, 450), ("treatment", "US", 0, 100),
    ("control", "UK", 1, 100), ("control", "UK", 0, 400), ("treatment", "UK", 1, 12), ("treatment", "UK", 0, 38),
]


def test_simpson_reversal(units, spec):
    # Both strata favour the treatment and so does the total: no reversal.
    row = proportions.simpson_check(units(REVERSAL), spec).first()
    assert not row.strata_disagree and not row.reverses_overall
    # The smaller stratum now favours the control.
    flipped = [c for c in REVERSAL if c[:2] != ("treatment", "UK")] + [
        ("treatment", "UK", 1, 5), ("treatment", "UK", 0, 45)]
    row = proportions.simpson_check(units(flipped), spec).first()
    assert row.strata_disagree and row.reverses_overall and row.overall_direction == "treatment_higher"


def test_true_paradox(units, spec):
    # Every stratum favours the treatment, the total favours the control.
    cells = [
        ("control", "US", 1, 810), ("control", "US", 0, 190), ("treatment", "US", 1, 85), ("treatment", "US", 0, 15),
        ("control", "UK", 1, 10), ("control", "UK", 0, 90), ("treatment", "UK", 1, 150), ("treatment", "UK", 0, 850),
    ]
    row = proportions.simpson_check(units(cells), spec).first()
    assert not row.strata_disagree and row.reverses_overall and row.overall_direction == "control_higher"
    adjusted = proportions.stratum_adjusted(units(cells), spec).first()
    assert adjusted.crude_diff < 0 < adjusted.mh_diff


def test_ties_count_for_the_treatment(units, spec):
    cells = [("control", "US", 1, 5), ("control", "US", 0, 5), ("treatment", "US", 1, 5), ("treatment", "US", 0, 5)]
    row = proportions.simpson_check(units(cells), spec).first()
    assert row.n_treatment_higher == 1 and row.any_treatment_higher


def test_small_cells_are_left_out(units, spec):
    cells = [("control", "US", 1, 99), ("treatment", "US", 1, 500), ("control", "UK", 1, 100), ("treatment", "UK", 0, 100)]
    got = proportions.subgroup_effects(units(cells), spec, ["country"]).collect()
    assert [r.country for r in got] == ["UK"]
    assert got[0].cate_pp == pytest.approx(-100)


@pytest.fixture
def numbers(spark):
    rng = np.random.default_rng(3)
    rows = [("x", "control" if i % 2 else "treatment", float(v)) for i, v in enumerate(rng.gamma(2, 300, 400))]
    df = spark.createDataFrame(rows, "experiment string, group string, time_seconds double")
    c = np.array([r[2] for r in rows if r[1] == "control"])
    t = np.array([r[2] for r in rows if r[1] == "treatment"])
    return df, c, t


def test_welch_and_pooled(numbers, spec):
    df, c, t = numbers
    v1, v2 = c.var(ddof=1) / len(c), t.var(ddof=1) / len(t)
    row = means.welch_t(df, spec).first()
    assert row.t == pytest.approx((c.mean() - t.mean()) / math.sqrt(v1 + v2))
    assert row.df == pytest.approx((v1 + v2) ** 2 / (v1**2 / (len(c) - 1) + v2**2 / (len(t) - 1)))
    assert row.p_value == pytest.approx(math.erfc(abs(row.t) / math.sqrt(2)), abs=0.01)
    pooled = means.pooled_t(df, spec).first()
    s2 = ((len(c) - 1) * c.var(ddof=1) + (len(t) - 1) * t.var(ddof=1)) / (len(c) + len(t) - 2)
    assert pooled.t == pytest.approx((c.mean() - t.mean()) / math.sqrt(s2 * (1 / len(c) + 1 / len(t))))


@pytest.mark.parametrize("ddof", [0, 1])
def test_two_sample_z_ddof(numbers, spec, ddof):
    df, c, t = numbers
    row = means.two_sample_z(df, spec, "time_seconds", ddof=ddof).first()
    assert row.se == pytest.approx(math.sqrt(c.var(ddof=ddof) / len(c) + t.var(ddof=ddof) / len(t)))


def test_location_summary(numbers, spec):
    df, c, t = numbers
    got = rows_by(means.location_summary(df, spec), "arm")
    assert got["control"].median_s == pytest.approx(np.median(c))
    assert got["treatment"].diff_to_control_s == pytest.approx(t.mean() - c.mean())
    assert got["treatment"].median_min == pytest.approx(np.median(t) / 60)


def test_histogram_integrates_to_one(numbers, spec):
    df, c, _ = numbers
    rows = [r for r in distribution.histogram(df, spec, "time_seconds", bins=20).collect() if r.arm == "control"]
    assert sum(r.n for r in rows) == len(c)
    assert sum(r.density * (r.bin_high - r.bin_low) for r in rows) == pytest.approx(1)


def test_histogram_of_one_value(spark, spec):
    df = spark.createDataFrame([("x", "control", 5.0)] * 3, "experiment string, group string, v double")
    row = distribution.histogram(df, spec, "v").first()
    assert (row.bin, row.n, row.density) == (0, 3, None)


def test_bucket_rates_of_empty_cells(spark, spec):
    rows = [("x", "control", 1, 30.0), ("x", "treatment", 0, 700.0), ("x", "control", 1, 3600.0)]
    df = spark.createDataFrame(rows, "experiment string, group string, converted int, time_seconds double")
    plain = rows_by(distribution.bucket_rates(df, spec), "bucket")
    assert set(plain) == {"0-10", "10-20"} and plain["0-10"].treatment_pct is None and plain["0-10"].diff_pp is None
    compat = rows_by(distribution.bucket_rates(df, spec, compat=True), "bucket")
    assert compat["0-10"].treatment_pct == 0 and compat["0-10"].diff_pp == -100


def test_summaries(units, spec):
    df = units(CELLS)
    got = rows_by(summaries.arm_summary(df, spec), "arm")
    assert (got["control"].n, got["control"].total) == (200, 30)
    ratio = summaries.class_ratio(df, spec).first()
    assert ratio.ratio == pytest.approx(325 / 75)
    shares = summaries.share_of_total(summaries.arm_summary(df, spec), "total").collect()
    assert sum(r.share for r in shares) == pytest.approx(1)


def test_cells_stand_for_rows(spark, units, spec):
    three = replace(spec, treatments=("treatment", "other"))
    df = units([("control", "US", 1, 40), ("control", "US", 0, 60), ("treatment", "US", 1, 55), ("treatment", "US", 0, 45), ("control", "CA", 1, 10),
                ("control", "CA", 0, 130), ("treatment", "CA", 0, 120), ("treatment", "CA", 1, 9), ("other", "CA", 1, 30)])
    df = df.unionByName(df.where("country = 'CA'").withColumn("country", F.lit(None).cast("string")))
    stored = summaries.cells(df, three, ["country"], ["converted", "time_seconds"])
    for metric in ("converted", "time_seconds"):
        for by in ((), ("country",)):
            a, b = (sorted(summaries.paired_arms(x, three, metric, by).collect(), key=repr) for x in (df, stored))
            assert len(a) == len(b)
            for r, q in zip(a, b):
                for c in r.asDict():
                    assert r[c] == (pytest.approx(q[c]) if isinstance(r[c], float) else q[c]), c
    z, same = (x.orderBy("treatment").collect() for x in (proportions.two_proportion_z(df, three), proportions.two_proportion_z(stored, three)))
    assert [r.z for r in z] == pytest.approx([r.z for r in same])
    with pytest.raises(ValueError):
        summaries.paired_arms(stored, three, "converted", ("speed",))

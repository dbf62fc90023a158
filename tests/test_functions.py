import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from armscope.functions import tails, timing
from armscope.functions.hashing import hash_arm, split_arm


def test_normal_tail_matches_erfc(spark):
    xs = [0.0, 0.3, 1.0, 1.959964, 3.5, 6.9, 7.07, 9.0, 20.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for row in df.withColumns({"t": tails.normal_tail(F.col("x")), "c": tails.normal_cdf(-F.col("x"))}).collect():
        want = 0.5 * math.erfc(row.x / math.sqrt(2))
        # The approximation is absolute up to 7.07 and asymptotic beyond.
        close = {"rel": 1e-3} if row.x > 7 else {"rel": 1e-8, "abs": 5e-16}
        assert row.t == pytest.approx(want, **close)
        assert row.c == pytest.approx(want, **close)


def test_null_statistic_gives_null_p(spark):
    row = spark.range(1).select(tails.two_sided_p(F.lit(None).cast("double")).alias("p")).first()
    assert row.p is None


@pytest.mark.parametrize(
    "x, df, want",
    [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
     (9.487729036781154, 4, 0.05), (18.307038053275146, 10, 0.05), (19.67513757268249, 11, 0.05), (0.0, 3, 1.0)],
)
def test_chi_square_tail(spark, x, df, want):
    got = spark.range(1).select(tails.chi_square_tail(F.lit(x), F.lit(df)).alias("p")).first().p
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(
    "t, df, want",
    [(12.706204736432095, 1, 0.05), (4.302652729911275, 2, 0.05), (2.2281388519649385, 10, 0.05),
     (1.9623391, 1000, 0.0499994), (0.0, 5, 1.0), (-2.2281388519649385, 10, 0.05)],
)
def test_student_tail(t, df, want):
    assert tails.student_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(want, abs=2e-6)


def test_student_tail_undefined():
    assert np.isnan(tails.student_two_sided(np.array([np.nan, 1.0]), np.array([3.0, 0.0]))).all()


def test_kolmogorov_tail(spark):
    df = spark.createDataFrame([(1.3580986,), (0.05,), (None,)], "x double")
    got = [r.p for r in df.select(tails.kolmogorov_tail(F.col("x")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-6) and got[1] == 1.0 and got[2] is None


def test_right_closed_buckets(spark):
    minutes = [0.0, 5.0, 10.0, 10.1, 60.0, 75.0, 95.0, None]
    df = spark.createDataFrame([(m,) for m in minutes], "m double")
    compat = [r.b for r in df.select(timing.right_closed_bucket(F.col("m"), compat=True).alias("b")).collect()]
    plain = [r.b for r in df.select(timing.right_closed_bucket(F.col("m")).alias("b")).collect()]
    assert compat == [0, 0, 0, 1, 5, 6, 0, 0]
    assert plain == [None, 0, 0, 1, 5, 6, None, None]


def test_half_open_buckets(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,), (59.9,), (60.0,), (-1.0,)], "m double")
    got = [r.b for r in df.select(timing.half_open_bucket(F.col("m")).alias("b")).collect()]
    assert got == [0, 0, 10, 50, None, None]


def test_time_text(spark):
    df = spark.createDataFrame([("00:11:48.6",), ("bad",), (None,), ("01:02:03",), ("1:2",)], "t string")
    plain = [r.s for r in df.select(timing.seconds_of_text(F.col("t")).alias("s")).collect()]
    compat = [r.s for r in df.select(timing.seconds_of_text(F.col("t"), compat=True).alias("s")).collect()]
    assert plain == [708.6, None, None, 3723.0, None]
    assert compat == [708.6, 0.0, 0.0, 3723.0, 0.0]


def test_split_shares(spark):
    df = spark.range(20000).select(
        split_arm("s", F.col("id"), [("control", 90), ("treatment", 10)]).alias("a"), hash_arm("s", F.col("id")).alias("b")
    )
    counts = {r.a: r["count"] for r in df.groupBy("a").count().collect()}
    assert counts["treatment"] / 20000 == pytest.approx(0.1, abs=0.01)
    halves = {r.b: r["count"] for r in df.groupBy("b").count().collect()}
    assert halves["control"] / 20000 == pytest.approx(0.5, abs=0.015)

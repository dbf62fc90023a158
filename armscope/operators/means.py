"""Tests on means: Welch and pooled t, unpooled z, location summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import ratio, verdict
from armscope.functions.tails import student_p, two_sided_p
from armscope.operators.ranks import described
from armscope.operators.summaries import paired_arms
from armscope.spec import ExperimentSpec


def _variance_of_mean(arm: str, ddof: int = 1) -> Column:
    n, var = F.col(f"n_{arm}"), F.col(f"var_{arm}")
    if ddof == 0:
        var = var * ratio(n - 1, n)
        # One row has no sample variance but a population variance of 0.
        var = F.when(n == 1, 0.0).otherwise(var)
    return ratio(var, n)


def welch_t(
    df: DataFrame,
    spec: ExperimentSpec,
    metric: str | None = None,
    by: Sequence[str] = (),
    where: Column | None = None,
    p_values: bool = True,
) -> DataFrame:
    """Unequal-variance t, control minus treatment, with Satterthwaite degrees of freedom."""
    cells = paired_arms(df, spec, metric or spec.time, by, where)
    return welch_from_moments(cells, spec, by, p_values)


def welch_from_moments(
    cells: DataFrame, spec: ExperimentSpec, by: Sequence[str] = (), p_values: bool = True
) -> DataFrame:
    cells = cells.withColumns({"_v1": _variance_of_mean("c"), "_v2": _variance_of_mean("t")})
    v1, v2 = F.col("_v1"), F.col("_v2")
    out = cells.select(
        *spec.keys,
        *by,
        "treatment",
        "n_c",
        "n_t",
        "mean_c",
        "mean_t",
        ratio(F.col("mean_c") - F.col("mean_t"), F.sqrt(v1 + v2)).alias("t"),
        ratio(
            (v1 + v2) * (v1 + v2), ratio(v1 * v1, F.col("n_c") - 1) + ratio(v2 * v2, F.col("n_t") - 1)
        ).alias("df"),
    )
    return out.withColumn("p_value", student_p("t", "df")) if p_values else out


def pooled_t(
    df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = (), p_values: bool = True
) -> DataFrame:
    """Equal-variance t, control minus treatment."""
    cells = paired_arms(df, spec, metric or spec.time, by)
    n1, n2 = F.col("n_c"), F.col("n_t")
    pooled = ratio((n1 - 1) * F.col("var_c") + (n2 - 1) * F.col("var_t"), n1 + n2 - 2)
    se = F.sqrt(pooled * (ratio(F.lit(1), n1) + ratio(F.lit(1), n2)))
    out = cells.select(
        *spec.keys,
        *by,
        "treatment",
        "n_c",
        "n_t",
        ratio(F.col("mean_c") - F.col("mean_t"), se).alias("t"),
        (n1 + n2 - 2).cast("double").alias("df"),
    )
    return out.withColumn("p_value", student_p("t", "df")) if p_values else out


def two_sample_z(
    df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = (), ddof: int = 0
) -> DataFrame:
    """Unpooled z, control minus treatment; ``ddof`` 0 takes population variances."""
    cells = paired_arms(df, spec, metric, by)
    out = cells.select(
        *spec.keys,
        *by,
        "treatment",
        "n_c",
        "n_t",
        (F.col("mean_c") - F.col("mean_t")).alias("diff"),
        F.sqrt(_variance_of_mean("c", ddof) + _variance_of_mean("t", ddof)).alias("se"),
    )
    out = out.withColumn("z", ratio(F.col("diff"), F.col("se")))
    out = out.withColumn("p_value", two_sided_p(F.col("z")))
    return out.withColumn("verdict", verdict(F.col("p_value"), spec.alpha))


def location_summary(
    df: DataFrame, spec: ExperimentSpec, value: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """n, mean and exact median per arm, in seconds and minutes, and the mean difference to the control.

    An arm whose values are all null has n 0.
    """
    value = value or spec.time
    data = df.withColumn("arm", F.col(spec.arm))
    groups = [*spec.keys, *by, "arm"]
    named = {"mean": "mean_s", "sd": "sd_s"}
    both = described(data, groups, value, {"median_s": 0.5}).withColumnsRenamed(named)
    control = F.max(F.when(F.col("arm") == spec.control, F.col("mean_s"))).over(
        Window.partitionBy(*spec.keys, *by)
    )
    return both.select(
        *groups,
        "n",
        "mean_s",
        "sd_s",
        "median_s",
        (F.col("mean_s") / 60).alias("mean_min"),
        (F.col("median_s") / 60).alias("median_min"),
        (F.col("mean_s") - control).alias("diff_to_control_s"),
    )

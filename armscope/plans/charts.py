"""The tables behind the charts of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import ratio
from armscope.operators.summaries import arm_summary
from armscope.spec import ExperimentSpec

ALL = "ALL"


def conversion_rates(units: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Rates by stratum and arm, and overall under the stratum ``ALL``; the overall rows add up the strata."""
    strata = arm_summary(units, spec, by=[spec.stratum]).select(*spec.keys, spec.stratum, "arm", "n", "total")
    both = strata.withColumn(spec.stratum, F.explode(F.array(F.col(spec.stratum), F.lit(ALL))))
    return (
        both.groupBy(*spec.keys, spec.stratum, "arm")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        .withColumn("rate_pct", ratio(F.col("total"), F.col("n")) * 100)
    )


def interval(z_tests: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Centre and half width of the interval, in points."""
    return z_tests.select(
        *spec.keys,
        "treatment",
        (F.col("diff") * 100).alias("diff_pp"),
        (spec.ci_z * F.col("se_diff") * 100).alias("half_width_pp"),
        "p_value",
    )


def stratum_differences(stratified: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Difference per stratum with its sign and, on every row, the overall difference of the experiment."""
    whole = Window.partitionBy(*spec.keys, "treatment")
    overall = ratio(F.sum("total_c").over(whole), F.sum("n_c").over(whole)) - ratio(
        F.sum("total_t").over(whole), F.sum("n_t").over(whole)
    )
    return stratified.select(
        *spec.keys,
        "treatment",
        spec.stratum,
        (F.col("diff") * 100).alias("diff_pp"),
        F.when(F.col("diff") > 0, "control_higher").otherwise("treatment_higher").alias("colour"),
        (overall * 100).alias("overall_diff_pp"),
    )


def adjustment_comparison(cuped: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Variance, difference and half width before and after covariate adjustment, one row per method."""
    def row(method: str, variance: str, diff: str, se: str):
        return F.struct(
            F.lit(method).alias("method"),
            F.col(variance).alias("variance"),
            (F.col(diff) * 100).alias("diff_pp"),
            (spec.ci_z * F.col(se) * 100).alias("half_width_pp"),
        )

    return cuped.select(
        *spec.keys,
        F.inline(
            F.array(
                row("original", "var_original", "diff", "se"),
                row("adjusted", "var_adjusted", "diff_adj", "se_adj"),
            )
        ),
    )

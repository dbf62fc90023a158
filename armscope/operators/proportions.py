"""Lift, two-proportion tests, intervals, strata and Simpson checks over grouped counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import cohens_h, direction, ratio, verdict
from armscope.functions.tails import chi_square_tail, two_sided_p
from armscope.operators.summaries import paired_arms
from armscope.spec import ExperimentSpec


def lift(df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Treatment minus control in percentage points, and relative to the control in percent."""
    cells = paired_arms(df, spec, metric, by)
    return cells.select(
        *spec.keys,
        *by,
        "treatment",
        (F.col("mean_c") * 100).alias("control_pct"),
        (F.col("mean_t") * 100).alias("treatment_pct"),
        ((F.col("mean_t") - F.col("mean_c")) * 100).alias("lift_pp"),
        (ratio(F.col("mean_t") - F.col("mean_c"), F.col("mean_c")) * 100).alias("lift_rel_pct"),
    )


def with_z_test(cells: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Pooled z test and unpooled interval, control minus treatment, on ``paired_arms`` rows."""
    n1, n2 = F.col("n_c"), F.col("n_t")
    p1, p2 = F.col("p_c"), F.col("p_t")
    pooled = ratio(F.col("total_c") + F.col("total_t"), n1 + n2)
    cells = cells.withColumns(
        {"p_c": ratio(F.col("total_c"), n1), "p_t": ratio(F.col("total_t"), n2), "p_pool": pooled}
    )
    inverse = ratio(F.lit(1), n1) + ratio(F.lit(1), n2)
    cells = cells.withColumns(
        {
            "diff": p1 - p2,
            "se_pooled": F.sqrt(F.col("p_pool") * (1 - F.col("p_pool")) * inverse),
            "se_diff": F.sqrt(ratio(p1 * (1 - p1), n1) + ratio(p2 * (1 - p2), n2)),
        }
    )
    cells = cells.withColumns(
        {
            "z": ratio(F.col("diff"), F.col("se_pooled")),
            "ci_low": F.col("diff") - spec.ci_z * F.col("se_diff"),
            "ci_high": F.col("diff") + spec.ci_z * F.col("se_diff"),
        }
    )
    cells = cells.withColumn("p_value", two_sided_p(F.col("z")))
    return cells.withColumns(
        {
            "verdict": verdict(F.col("p_value"), spec.alpha),
            "direction": direction(p1, p2),
            # The interval is control minus treatment. The first flag, kept as it was, bounds the control's
            # gain; the second one bounds the treatment's, which is what a launch asks for.
            "negligible": (F.col("p_value") >= spec.alpha) & (F.col("ci_high") * 100 < spec.negligible_pp),
            "gain_negligible": (F.col("p_value") >= spec.alpha) & (-F.col("ci_low") * 100 < spec.negligible_pp),
        }
    )


def two_proportion_z(
    df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Two-proportion z test per experiment, cell and treatment. Null statistics where an arm is empty."""
    return with_z_test(paired_arms(df, spec, metric, by, moments=False), spec)


def stratified_z(df: DataFrame, spec: ExperimentSpec, metric: str | None = None) -> DataFrame:
    return two_proportion_z(df, spec, metric, by=(spec.stratum,))


def simpson_check(df: DataFrame, spec: ExperimentSpec, metric: str | None = None) -> DataFrame:
    """Do the strata disagree in direction, and does any contradict the overall direction?

    The overall direction comes from the strata totals, so the data are scanned once.
    """
    strata = stratified_z(df, spec, metric)
    counted = strata.groupBy(*spec.keys, "treatment").agg(
        F.count(F.lit(1)).alias("n_strata"),
        F.count_if(F.col("direction") == "treatment_higher").alias("n_treatment_higher"),
        F.count_if(F.col("direction") == "control_higher").alias("n_control_higher"),
        *[F.sum(c).alias(c) for c in ("n_c", "n_t", "total_c", "total_t")],
    )
    overall = direction(
        ratio(F.col("total_c"), F.col("n_c")), ratio(F.col("total_t"), F.col("n_t"))
    )
    up, down = F.col("n_treatment_higher") > 0, F.col("n_control_higher") > 0
    return counted.select(
        *spec.keys,
        "treatment",
        "n_strata",
        "n_treatment_higher",
        "n_control_higher",
        overall.alias("overall_direction"),
        (up & down).alias("strata_disagree"),
        up.alias("any_treatment_higher"),
        F.when(overall == "treatment_higher", down).when(overall == "control_higher", up).alias("reverses_overall"),
    )


def chi_square_2x2(
    df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Chi-square of arm against a 0/1 outcome, without continuity correction; equals z squared."""
    cells = paired_arms(df, spec, metric, by, moments=False)
    a, b = F.col("total_c").cast("double"), F.col("n_c") - F.col("total_c")
    c, d = F.col("total_t").cast("double"), F.col("n_t") - F.col("total_t")
    n = a + b + c + d
    chi2 = ratio(n * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))
    return cells.select(
        *spec.keys, *by, "treatment", "n_c", "total_c", "n_t", "total_t", chi2.alias("chi2")
    ).withColumn("p_value", chi_square_tail(F.col("chi2"), F.lit(1)))


def effect_size(df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's h of control against treatment."""
    cells = paired_arms(df, spec, metric, by)
    return cells.select(
        *spec.keys, *by, "treatment", "mean_c", "mean_t", cohens_h(F.col("mean_c"), F.col("mean_t")).alias("h")
    )


def stratum_adjusted(df: DataFrame, spec: ExperimentSpec, metric: str | None = None) -> DataFrame:
    """Effect controlled for the stratum: Mantel-Haenszel risk difference and odds ratio.

    Also the difference post-stratified to the population shares, with its standard error. Strata
    lacking an arm carry no information and drop out of all three.
    """
    s = paired_arms(df, spec, metric, (spec.stratum,), moments=False).filter((F.col("n_c") > 0) & (F.col("n_t") > 0))
    n1, n2 = F.col("n_t").cast("double"), F.col("n_c").cast("double")
    x1, x2 = F.col("total_t").cast("double"), F.col("total_c").cast("double")
    n = n1 + n2
    p1, p2 = x1 / n1, x2 / n2
    sums = s.groupBy(*spec.keys, "treatment").agg(
        F.count(F.lit(1)).alias("n_strata"),
        F.sum(n).alias("_n"),
        F.sum(n1 * n2 / n).alias("_w"),
        F.sum((x1 * n2 - x2 * n1) / n).alias("_wd"),
        F.sum(x1 * (n2 - x2) / n).alias("_or_top"),
        F.sum(x2 * (n1 - x1) / n).alias("_or_bottom"),
        F.sum(n * (p1 - p2)).alias("_nd"),
        F.sum(n * n * (p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)).alias("_nv"),
        (F.sum(x1) / F.sum(n1) - F.sum(x2) / F.sum(n2)).alias("crude_diff"),
    )
    out = sums.select(
        *spec.keys,
        "treatment",
        "n_strata",
        "crude_diff",
        ratio(F.col("_wd"), F.col("_w")).alias("mh_diff"),
        ratio(F.col("_or_top"), F.col("_or_bottom")).alias("mh_odds_ratio"),
        ratio(F.col("_nd"), F.col("_n")).alias("poststrat_diff"),
        ratio(F.sqrt(F.col("_nv")), F.col("_n")).alias("poststrat_se"),
    )
    out = out.withColumn("z", ratio(F.col("poststrat_diff"), F.col("poststrat_se")))
    return out.withColumn("p_value", two_sided_p(F.col("z")))


def subgroup_effects(
    df: DataFrame, spec: ExperimentSpec, by: Sequence[str], metric: str | None = None
) -> DataFrame:
    """Conditional effect (treatment minus control) per subgroup with its interval, in points.

    Subgroups with fewer than ``spec.min_cell`` units in either arm are left out.
    """
    cells = paired_arms(df, spec, metric, by).filter(
        (F.col("n_c") >= spec.min_cell) & (F.col("n_t") >= spec.min_cell)
    )
    se = F.sqrt(ratio(F.col("var_c"), F.col("n_c")) + ratio(F.col("var_t"), F.col("n_t")))
    cells = cells.select(
        *spec.keys,
        *by,
        "treatment",
        "n_c",
        "n_t",
        (F.col("mean_c") * 100).alias("control_pct"),
        (F.col("mean_t") * 100).alias("treatment_pct"),
        ((F.col("mean_t") - F.col("mean_c")) * 100).alias("cate_pp"),
        (se * 100).alias("se_pp"),
    )
    return cells.withColumns(
        {
            "ci_low_pp": F.col("cate_pp") - spec.ci_z * F.col("se_pp"),
            "ci_high_pp": F.col("cate_pp") + spec.ci_z * F.col("se_pp"),
        }
    )


def ranked_effects(effects: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Subgroup effects in ascending order with their rank."""
    cell = [c for c in effects.columns if c not in (*spec.keys, "treatment", "cate_pp")]
    order = Window.partitionBy(*spec.keys, "treatment").orderBy("cate_pp", *cell)
    return effects.withColumn("effect_rank", F.row_number().over(order)).orderBy("effect_rank")

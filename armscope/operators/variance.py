"""Variance reduction: covariate adjustment (CUPED) and analysis of covariance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.functions.effects import at_least, ratio
from armscope.functions.tails import student_p, two_sided_p
from armscope.operators.arms import each_treatment
from armscope.operators.joins import attach_per_group
from armscope.spec import ExperimentSpec


def _moments(df: DataFrame, spec: ExperimentSpec, y: str, x: str) -> DataFrame:
    """Overall and per-arm moments of (y, x) from one grouped scan; rows missing either are left out."""
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    cy, cx = F.when(both, F.col(y).cast("double")), F.when(both, F.col(x).cast("double"))
    columns = []
    for suffix, arm in (("", None), ("_c", spec.control), ("_t", spec.treatments[0])):
        ay = cy if arm is None else F.when(F.col(spec.arm) == arm, cy)
        ax = cx if arm is None else F.when(F.col(spec.arm) == arm, cx)
        columns += [
            F.count(ay).alias(f"n{suffix}"),
            F.avg(ay).alias(f"y{suffix}"),
            F.avg(ax).alias(f"x{suffix}"),
            F.var_pop(ay).alias(f"vy{suffix}"),
            F.var_pop(ax).alias(f"vx{suffix}"),
            F.covar_pop(ay, ax).alias(f"cxy{suffix}"),
        ]
    return df.groupBy(*spec.keys).agg(*columns)


def _theta(pooled_ddof: int):
    """Covariance over variance; ``pooled_ddof`` 1 divides a sample covariance by a population variance."""
    theta = ratio(F.col("cxy"), F.col("vx"))
    return theta * ratio(F.col("n"), F.col("n") - 1) if pooled_ddof else theta


@each_treatment
def cuped_theta(df: DataFrame, spec: ExperimentSpec, y: str, x: str, ddof: int = 1) -> DataFrame:
    """The adjustment slope and the covariate's mean, over the units of all arms."""
    return _moments(df, spec, y, x).select(
        *spec.keys, "n", _theta(ddof).alias("theta"), F.col("x").alias("mean_x")
    )


@each_treatment
def cuped_adjust(
    df: DataFrame, spec: ExperimentSpec, y: str, x: str, out: str = "y_adj", ddof: int = 1
) -> DataFrame:
    """Row-level y - theta (x - mean x). The slope table has one row per experiment."""
    slopes = cuped_theta(df, spec, y, x, ddof).withColumnsRenamed({"theta": "_theta", "mean_x": "_mean_x"})
    joined = attach_per_group(df, slopes.drop("n"), spec.keys)
    adjusted = F.col(y) - F.col("_theta") * (F.col(x) - F.col("_mean_x"))
    return joined.withColumn(out, adjusted).drop("_theta", "_mean_x")


@each_treatment
def cuped_report(
    df: DataFrame, spec: ExperimentSpec, y: str, x: str, ddof: int = 1, pre_period: bool = True
) -> DataFrame:
    """Variance and z test before and after adjustment, without writing adjusted rows.

    var(y - theta x) = var y - 2 theta cov + theta^2 var x holds overall and inside each arm.
    ``pre_period`` only labels whether the covariate precedes the experiment, as it should.
    """
    m = _moments(df, spec, y, x).withColumn("theta", _theta(ddof))
    theta = F.col("theta")

    def adjusted(suffix: str):
        return (
            F.col(f"vy{suffix}")
            - 2 * theta * F.col(f"cxy{suffix}")
            + theta * theta * F.col(f"vx{suffix}")
        )

    m = m.withColumns({f"va{s}": at_least(adjusted(s), 0.0) for s in ("", "_c", "_t")})
    m = m.withColumns(
        {
            "diff": F.col("y_c") - F.col("y_t"),
            "diff_adj": F.col("y_c") - F.col("y_t") - theta * (F.col("x_c") - F.col("x_t")),
            "se": F.sqrt(ratio(F.col("vy_c"), F.col("n_c")) + ratio(F.col("vy_t"), F.col("n_t"))),
            "se_adj": F.sqrt(ratio(F.col("va_c"), F.col("n_c")) + ratio(F.col("va_t"), F.col("n_t"))),
        }
    )
    m = m.withColumns({"z": ratio(F.col("diff"), F.col("se")), "z_adj": ratio(F.col("diff_adj"), F.col("se_adj"))})
    return m.select(
        *spec.keys,
        "n_c",
        "n_t",
        "theta",
        F.col("vy").alias("var_original"),
        F.col("va").alias("var_adjusted"),
        ((1 - ratio(F.col("va"), F.col("vy"))) * 100).alias("variance_reduction_pct"),
        "diff",
        "diff_adj",
        "se",
        "se_adj",
        "z",
        "z_adj",
        two_sided_p(F.col("z")).alias("p_value"),
        two_sided_p(F.col("z_adj")).alias("p_value_adj"),
        ((1 - ratio(F.col("se_adj"), F.col("se"))) * 100).alias("se_reduction_pct"),
        ((ratio(F.col("se") * F.col("se"), F.col("se_adj") * F.col("se_adj")) - 1) * 100).alias(
            "equivalent_sample_pct"
        ),
        F.lit(pre_period).alias("covariate_pre_period"),
    )


@each_treatment
def ancova(
    df: DataFrame, spec: ExperimentSpec, y: str, x: str, p_values: bool = True
) -> DataFrame:
    """Least squares of y on arm and one covariate, in closed form from one grouped scan.

    The effect is treatment minus control at equal covariate.
    """
    arm = F.when(F.col(spec.arm) == spec.treatments[0], 1.0).when(F.col(spec.arm) == spec.control, 0.0)
    rows = df.select(
        *spec.keys, arm.alias("_a"), F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x")
    ).dropna(subset=["_a", "_y", "_x"])
    n = F.count(F.lit(1))
    sums = rows.groupBy(*spec.keys).agg(
        n.alias("n"),
        *[(F.var_pop(c) * n).alias(f"s{c}") for c in ("_a", "_x", "_y")],
        (F.covar_pop("_a", "_x") * n).alias("ax"),
        (F.covar_pop("_a", "_y") * n).alias("ay"),
        (F.covar_pop("_x", "_y") * n).alias("xy"),
    )
    a, xx, yy = F.col("s_a"), F.col("s_x"), F.col("s_y")
    ax, ay, xy = F.col("ax"), F.col("ay"), F.col("xy")
    det = a * xx - ax * ax
    sums = sums.withColumns(
        {"effect": ratio(ay * xx - ax * xy, det), "slope": ratio(a * xy - ax * ay, det), "_det": det}
    )
    rss = yy - F.col("effect") * ay - F.col("slope") * xy
    out = sums.withColumn("se", F.sqrt(ratio(rss, F.col("n") - 3) * ratio(xx, F.col("_det"))))
    out = out.select(
        *spec.keys,
        "n",
        ratio(ay, a).alias("effect_unadjusted"),
        "effect",
        "slope",
        "se",
        ratio(F.col("effect"), F.col("se")).alias("t"),
        (F.col("n") - 3).cast("double").alias("df"),
    )
    return out.withColumn("p_value", student_p("t", "df")) if p_values else out

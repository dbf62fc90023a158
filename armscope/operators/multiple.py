"""Several metrics at once, and corrections for testing many hypotheses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import at_least, ratio
from armscope.functions.tails import two_sided_p
from armscope.operators.arms import each_treatment
from armscope.operators.means import two_sample_z
from armscope.spec import ExperimentSpec


@dataclass(frozen=True)
class Metric:
    """A metric of the decision: its column, its role and which way is good (+1 up, -1 down)."""

    name: str
    column: str
    role: str = "secondary"
    good: int = 1


def metric_tests(
    df: DataFrame, spec: ExperimentSpec, metrics: Sequence[Metric], by: Sequence[str] = ()
) -> DataFrame:
    """Unpooled z test of each metric in one scan: rows are stacked and combined before the shuffle."""
    stacked = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("metric"),
                F.lit(m.role).alias("role"),
                F.lit(m.good).alias("good"),
                F.col(m.column).cast("double").alias("_value"),
            )
            for m in metrics
        ]
    )
    long = df.select(*spec.keys, *by, spec.arm, F.inline(stacked))
    tests = two_sample_z(long, spec, "_value", [*by, "metric", "role", "good"], ddof=1)
    # Treatment minus control from here on: a positive effect is an increase.
    return tests.select(
        *spec.keys,
        *by,
        "metric",
        "role",
        "good",
        "treatment",
        "n_c",
        "n_t",
        (-F.col("diff")).alias("effect"),
        "se",
        "p_value",
        (-F.col("diff") - spec.ci_z * F.col("se")).alias("ci_low"),
        (-F.col("diff") + spec.ci_z * F.col("se")).alias("ci_high"),
    )


def correct_p_values(
    tests: DataFrame,
    groups: Sequence[str],
    alpha: float = 0.05,
    order: Sequence[str] = (),
    tier: Column | None = None,
    tier_alphas: Mapping[str, float] | None = None,
) -> DataFrame:
    """Bonferroni, Benjamini-Hochberg and tiered decisions over the tests of each group.

    Ties in p are broken by ``order`` only for the rank; adjusted values do not depend on it. The
    table has one row per hypothesis, so windows over a group stay small.
    """
    ascending = Window.partitionBy(*groups).orderBy("p_value", *order)
    whole = Window.partitionBy(*groups)
    # Largest p first: the running minimum of p k / rank.
    upward = Window.partitionBy(*groups).orderBy(F.col("_rank").desc())
    out = tests.filter(F.col("p_value").isNotNull())
    out = out.withColumns(
        {"_rank": F.row_number().over(ascending), "n_tests": F.count(F.lit(1)).over(whole)}
    )
    k = F.col("n_tests")
    out = out.withColumns(
        {
            "p_bonferroni": F.least(F.lit(1.0), F.col("p_value") * k),
            "p_bh": F.least(F.lit(1.0), F.min(F.col("p_value") * k / F.col("_rank")).over(upward)),
            "alpha_bonferroni": F.lit(alpha) / k,
            "family_error": 1 - F.pow(F.lit(1 - alpha), k),
        }
    )
    out = out.withColumns(
        {
            "reject_raw": F.col("p_value") < alpha,
            "reject_bonferroni": F.col("p_value") < F.col("alpha_bonferroni"),
            "reject_bh": F.col("p_bh") <= alpha,
        }
    )
    if tier is not None:
        limit = F.lit(None).cast("double")
        for name, value in (tier_alphas or {}).items():
            limit = F.when(tier == name, value).otherwise(limit)
        out = out.withColumn("tier_alpha", limit).withColumn("reject_tiered", F.col("p_value") < limit)
    return out.drop("_rank")


@each_treatment
def quasi_poisson(
    df: DataFrame, spec: ExperimentSpec, count: str, exposure: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Rate ratio of counts with a standard error widened by the observed overdispersion.

    Rates are counts per exposure (per unit by default). The dispersion is the Pearson statistic of
    the two fitted rates over its degrees of freedom; also gives the moment estimate of the negative
    binomial's 1/size.
    """
    e = F.col(exposure).cast("double") if exposure else F.lit(1.0)
    y = F.col(count).cast("double")
    columns = []
    for suffix, arm in (("c", spec.control), ("t", spec.treatments[0])):
        mine = F.col(spec.arm) == arm
        usable = mine & (e > 0) & y.isNotNull()
        columns += [
            F.count_if(usable).alias(f"n_{suffix}"),
            F.sum(F.when(usable, y)).alias(f"y_{suffix}"),
            F.sum(F.when(usable, e)).alias(f"e_{suffix}"),
            F.sum(F.when(usable, y * y / e)).alias(f"_yye_{suffix}"),
        ]
    m = df.groupBy(*spec.keys, *by).agg(*columns)
    # sum (y - r e)^2 / (r e) = sum y^2/e / r - y
    pearson = F.lit(0.0)
    for s in ("c", "t"):
        rate = ratio(F.col(f"y_{s}"), F.col(f"e_{s}"))
        pearson = pearson + ratio(F.col(f"_yye_{s}"), rate) - F.col(f"y_{s}")
    m = m.withColumns(
        {
            "rate_c": ratio(F.col("y_c"), F.col("e_c")),
            "rate_t": ratio(F.col("y_t"), F.col("e_t")),
            "dispersion": ratio(pearson, F.col("n_c") + F.col("n_t") - 2),
        }
    )
    se = F.sqrt(ratio(F.lit(1), F.col("y_c")) + ratio(F.lit(1), F.col("y_t")))
    mean = ratio(F.col("y_c") + F.col("y_t"), F.col("n_c") + F.col("n_t"))
    m = m.withColumns(
        {
            "rate_ratio": ratio(F.col("rate_t"), F.col("rate_c")),
            "se_log_poisson": se,
            "se_log": se * F.sqrt(at_least(F.col("dispersion"), 1.0)),
            "inverse_size": at_least(ratio(F.col("dispersion") - 1, mean), 0.0),
        }
    )
    m = m.withColumn("z", ratio(F.ln("rate_ratio"), F.col("se_log")))
    m = m.withColumns(
        {
            "ratio_low": F.exp(F.ln("rate_ratio") - spec.ci_z * F.col("se_log")),
            "ratio_high": F.exp(F.ln("rate_ratio") + spec.ci_z * F.col("se_log")),
            "p_value": two_sided_p(F.col("z")),
        }
    )
    return m.drop("_yye_c", "_yye_t", "e_c", "e_t")

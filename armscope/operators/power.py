"""Sample sizes, power curves and durations from observed baselines, by closed form."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.functions.effects import cohens_h, ratio
from armscope.functions.tails import normal_cdf
from armscope.operators.summaries import paired_arms
from armscope.spec import ExperimentSpec

# Relative minimum detectable effects, the target among them, and the curve's range.
MDE_GRID = (0.01, 0.02, 0.05, 0.10)
TARGET_MDE = 0.01
CURVE_START, CURVE_END, CURVE_POINTS = 10_000, 2_000_000, 100


def baselines(
    df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Control rate and the size of the smaller arm, per experiment, cell and treatment."""
    return paired_arms(df, spec, metric, by).select(
        *spec.keys,
        *by,
        "treatment",
        F.col("mean_c").alias("baseline"),
        F.least("n_c", "n_t").alias("current_n"),
    )


def _effect(baseline: Column, mde: Column) -> Column:
    raised = baseline * (1 + mde)
    return F.when(raised <= 1, cohens_h(baseline, raised))


def required_n(h: Column, spec: ExperimentSpec) -> Column:
    """Units per arm for a two-sided test of two equal arms: 2 (z_alpha/2 + z_beta)^2 / h^2."""
    return ratio(F.lit(2 * (spec.z_alpha + spec.z_power) ** 2), h * h)


def sample_sizes(base: DataFrame, spec: ExperimentSpec, mdes: Sequence[float] = MDE_GRID) -> DataFrame:
    """Required n per arm for each relative effect, and how far the current n goes.

    The grid is a literal array exploded on the baseline rows, so no join is needed.
    """
    grid = F.array(*[F.lit(float(m)) for m in mdes])
    out = base.select("*", F.explode(grid).alias("mde"))
    out = out.withColumns(
        {
            "mde_pp": F.col("baseline") * F.col("mde") * 100,
            "h": _effect(F.col("baseline"), F.col("mde")),
        }
    )
    out = out.withColumn("n_required", required_n(F.col("h"), spec))
    return out.withColumns(
        {
            "current_share": ratio(F.col("current_n"), F.col("n_required")),
            "shortfall": ratio(F.col("n_required"), F.col("current_n")),
        }
    )


def target_shortfall(base: DataFrame, spec: ExperimentSpec, mde: float = TARGET_MDE) -> DataFrame:
    return sample_sizes(base, spec, [mde])


def power_at(h: Column, n: Column, spec: ExperimentSpec) -> Column:
    """Two-sided power of ``n`` units per arm."""
    shift = F.abs(h) * F.sqrt(n / 2)
    return normal_cdf(shift - spec.z_alpha) + normal_cdf(-shift - spec.z_alpha)


def power_curve(
    base: DataFrame,
    spec: ExperimentSpec,
    mde: float = TARGET_MDE,
    start: int = CURVE_START,
    end: int = CURVE_END,
    points: int = CURVE_POINTS,
) -> DataFrame:
    """Power at evenly spaced sample sizes; carries the current and required n for the chart."""
    step = (end - start) / (points - 1)
    out = target_shortfall(base, spec, mde).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    out = out.withColumn("n", F.lit(float(start)) + F.col("point") * F.lit(step))
    return out.withColumn("power", power_at(F.col("h"), F.col("n"), spec))


def achieved_power(base: DataFrame, spec: ExperimentSpec, mdes: Sequence[float] = MDE_GRID) -> DataFrame:
    """Power of the current n for each effect of the grid."""
    out = sample_sizes(base, spec, mdes)
    return out.withColumn("power", power_at(F.col("h"), F.col("current_n"), spec))


def daily_units(log: DataFrame, spec: ExperimentSpec, ts: str = "ts") -> DataFrame:
    """Distinct units per day, by two levels of grouping so that a hot day spreads over tasks."""
    day = F.to_date(F.col(ts)).alias("day")
    return (
        log.select(*spec.keys, spec.unit, day)
        .distinct()
        .groupBy(*spec.keys, "day")
        .agg(F.count(spec.unit).alias("units"))
    )


def planned_units(h: Column, share_c: Column, share_t: Column, spec: ExperimentSpec) -> Column:
    """Units of the whole experiment until two arms with these shares of it reach the power: with n_c and n_t units,
    h^2 n_c n_t / (n_c + n_t) has to be (z_alpha/2 + z_beta)^2."""
    return ratio(F.lit((spec.z_alpha + spec.z_power) ** 2) * (share_c + share_t), h * h * share_c * share_t)


def duration_days(
    log: DataFrame, base: DataFrame, spec: ExperimentSpec, mde: float = TARGET_MDE, ts: str = "ts"
) -> DataFrame:
    """Days until each treatment and the control have the units they need under the planned shares, at the average
    daily traffic: whole weeks, 7 days at least. n_required is the treatment's, n_control the control's."""
    traffic = daily_units(log, spec, ts).groupBy(*spec.keys).agg(F.avg("units").alias("daily_units"))
    shares = spec.planned_shares
    share_t = F.lit(None).cast("double")
    for t in spec.treatments:
        share_t = F.when(F.col("treatment") == t, shares[t]).otherwise(share_t)
    share_c = F.lit(shares[spec.control])
    sized = target_shortfall(base, spec, mde).join(traffic, list(spec.keys))
    whole = planned_units(F.col("h"), share_c, share_t, spec)
    days = F.ceil(ratio(whole, F.col("daily_units")))
    return sized.select(
        *spec.keys,
        "treatment",
        "mde",
        (whole * share_t).alias("n_required"),
        (whole * share_c).alias("n_control"),
        "daily_units",
        days.alias("min_days"),
        (F.when(days.isNotNull(), F.greatest(F.ceil(days / 7), F.lit(1))) * 7).alias("planned_days"),
    )


def sample_size_for(baseline: float, mde: float, spec: ExperimentSpec) -> float:
    """The same closed form for one planned experiment, without data."""
    h = 2 * math.asin(math.sqrt(baseline)) - 2 * math.asin(math.sqrt(baseline * (1 + mde)))
    return 2 * (spec.z_alpha + spec.z_power) ** 2 / h**2

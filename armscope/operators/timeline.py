"""Effects over time: day since first exposure, and the guard against peeking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.operators.arms import each_treatment
from armscope.operators.proportions import with_z_test
from armscope.operators.summaries import paired_arms
from armscope.spec import ExperimentSpec


def _daily(log: DataFrame, spec: ExperimentSpec, metric: str, ts: str) -> DataFrame:
    """Counts per unit and day: a unit with very many rows shrinks to one row per day."""
    return log.groupBy(*spec.keys, spec.unit, spec.arm, F.to_date(F.col(ts)).alias("day")).agg(
        F.count(metric).alias("_n"), F.sum(metric).alias("_x")
    )


def _arms_by_day(daily: DataFrame, spec: ExperimentSpec, day: str) -> DataFrame:
    columns = []
    for suffix, arm in (("c", spec.control), ("t", spec.treatments[0])):
        mine = F.col(spec.arm) == arm
        columns += [
            F.coalesce(F.sum(F.when(mine, F.col("_n"))), F.lit(0)).alias(f"n_{suffix}"),
            F.coalesce(F.sum(F.when(mine, F.col("_x"))), F.lit(0)).alias(f"total_{suffix}"),
        ]
    return daily.groupBy(*spec.keys, day).agg(*columns)


@each_treatment
def lift_by_exposure_day(
    log: DataFrame, spec: ExperimentSpec, metric: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Conversion by day since the unit's first exposure: novelty fades, learning grows."""
    daily = _daily(log, spec, metric or spec.metric, ts)
    first = F.min("day").over(Window.partitionBy(*spec.keys, spec.unit))
    aged = daily.withColumn("exposure_day", F.date_diff(F.col("day"), first))
    cells = with_z_test(_arms_by_day(aged, spec, "exposure_day"), spec)
    return cells.select(
        *spec.keys,
        "exposure_day",
        "n_c",
        "n_t",
        "p_c",
        "p_t",
        ((F.col("p_t") - F.col("p_c")) * 100).alias("lift_pp"),
        "z",
        "p_value",
    )


@each_treatment
def peeking_guard(
    log: DataFrame, spec: ExperimentSpec, planned_n: int, metric: str | None = None, ts: str = "ts"
) -> DataFrame:
    """Cumulative z per day, whether a peeker would have stopped, and the verdict at the planned size.

    ``planned_n`` counts observations in the smaller arm. The running window covers days, not rows.
    """
    day = F.to_date(F.col(ts)).alias("day")
    metric = metric or spec.metric
    rows = log.select(*spec.keys, F.col(spec.arm), day, F.col(metric).alias("_y"))
    daily = rows.groupBy(*spec.keys, spec.arm, "day").agg(
        F.count("_y").alias("_n"), F.sum("_y").alias("_x")
    )
    by_day = _arms_by_day(daily, spec, "day")
    sofar = Window.partitionBy(*spec.keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = by_day.withColumns(
        {c: F.sum(c).over(sofar) for c in ("n_c", "n_t", "total_c", "total_t")}
    )
    tested = with_z_test(running, spec).select(*spec.keys, "day", "n_c", "n_t", "z", "p_value")
    reached = F.least("n_c", "n_t") >= planned_n
    tested = tested.withColumns(
        {"significant_today": F.coalesce(F.col("p_value") < spec.alpha, F.lit(False)), "planned_reached": reached}
    )
    tested = tested.withColumns(
        {
            "peeker_stopped": F.bool_or("significant_today").over(sofar),
            "_first_planned": F.row_number().over(
                Window.partitionBy(*spec.keys, "planned_reached").orderBy("day")
            )
            == 1,
        }
    )
    at_plan = F.col("planned_reached") & F.col("_first_planned")
    return tested.withColumn(
        "fixed_horizon_verdict",
        F.when(at_plan & F.col("significant_today"), "significant").when(at_plan, "not_significant"),
    ).drop("_first_planned")

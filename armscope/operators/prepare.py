"""Checks and cleaning: consistency filter, first exposure, dimension join, features, quality rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import ratio
from armscope.functions.timing import right_closed_bucket
from armscope.spec import ExperimentSpec

QUICK_SECONDS = 1800


def shows_wrong_page(spec: ExperimentSpec, arm: str) -> Column:
    """True where a row of ``arm`` shows another arm's page; unknown or missing pages are no mismatch."""
    others = [p for a, p in spec.arm_pages.items() if p != spec.arm_pages[arm]]
    return F.coalesce(
        (F.col(spec.arm) == arm) & F.col(spec.page).isin(others), F.lit(False)
    )


def mismatch(spec: ExperimentSpec) -> Column:
    parts = [shows_wrong_page(spec, arm) for arm in spec.arm_pages]
    total = parts[0]
    for part in parts[1:]:
        total = total | part
    return total


def drop_mismatched(log: DataFrame, spec: ExperimentSpec) -> DataFrame:
    return log.filter(~mismatch(spec))


def mismatch_counts(log: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Rows whose page contradicts the arm, per arm and in total, in one scan."""
    return log.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(shows_wrong_page(spec, arm)).alias(f"mismatch_{arm}") for arm in spec.arm_pages],
        F.count_if(mismatch(spec)).alias("mismatch_total"),
    )


def first_exposure(log: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """The earliest row of each unit by ``spec.order``.

    The limit to rank 1 runs before the shuffle too, so a unit with very many rows sends at
    most one row per input task.
    """
    order = Window.partitionBy(*spec.keys, spec.unit).orderBy(*spec.order)
    return log.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def duplicate_counts(log: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Rows beyond the first of their unit; all rows without a unit id count as one unit."""
    units = log.groupBy(*spec.keys, spec.unit).agg(F.count(F.lit(1)).alias("_n"))
    return units.groupBy(*spec.keys).agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_units"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicates"),
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows and nulls, from a single aggregate."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return counted.select(F.col("_rows").alias("n_rows"), F.inline(pairs))


def attach_dimension(units: DataFrame, dimension: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Inner join on the unit: units without a dimension row drop out, repeated keys multiply rows.

    No broadcast is forced: the optimizer broadcasts a dimension below its size threshold and
    otherwise sorts and merges, splitting skewed partitions.
    """
    return units.join(dimension, spec.unit, "inner")


def prepare(log: DataFrame, dimension: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Consistency filter, then first exposure, then dimension join; the order decides the result."""
    return attach_dimension(first_exposure(drop_mismatched(log, spec), spec), dimension, spec)


def add_features(
    df: DataFrame, spec: ExperimentSpec, strata: Sequence[str], compat: bool = False
) -> DataFrame:
    """Indicators, time buckets and treatment interactions; ``strata`` are the levels to encode.

    The last level gets an indicator but no interaction: it is the baseline of the models.
    """
    treated = F.col(spec.arm).isin(*spec.treatments).cast("int")
    seconds = F.col(spec.time)
    df = df.withColumns(
        {
            "time_min": seconds / 60,
            "is_treatment": treated,
            "quick_user": (seconds < QUICK_SECONDS).cast("int"),
            "slow_user": (seconds >= QUICK_SECONDS).cast("int"),
            "time_min_bucket": right_closed_bucket(seconds / 60, compat=compat),
            **{f"{spec.stratum}_{s}": (F.col(spec.stratum) == s).cast("int") for s in strata},
        }
    )
    return df.withColumns(
        {
            "treatment_x_time": F.col("is_treatment") * seconds,
            **{
                f"treatment_x_{s}": F.col("is_treatment") * F.col(f"{spec.stratum}_{s}")
                for s in strata[:-1]
            },
            "treatment_x_quick": F.col("is_treatment") * F.col("quick_user"),
        }
    )


def units_without_dimension(units: DataFrame, dimension: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Units the inner join would lose."""
    return units.join(dimension.select(spec.unit), spec.unit, "left_anti")


def integrity_report(
    log: DataFrame, dimension: DataFrame, spec: ExperimentSpec, planned_n: int, has_date: bool
) -> DataFrame:
    """Check table: check, value, threshold, passed. One row per experiment and check."""
    per_unit = log.groupBy(*spec.keys, spec.unit).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(mismatch(spec)).alias("_bad"),
        F.count_if(F.col(spec.metric).isNull()).alias("_null_metric"),
        *[
            F.max((F.col(spec.arm).eqNullSafe(arm) & ~mismatch(spec)).cast("int")).alias(f"_in_{arm}")
            for arm in spec.arms
        ],
    )
    flagged = per_unit.join(
        dimension.select(spec.unit).distinct().withColumn("_known", F.lit(1)), spec.unit, "left"
    )
    totals = flagged.groupBy(*spec.keys).agg(
        F.sum("_rows").alias("rows"),
        F.sum("_bad").alias("bad"),
        (F.sum("_rows") - F.count(F.lit(1))).alias("dup"),
        F.sum("_null_metric").alias("null_metric"),
        F.sum(F.when(F.col(spec.unit).isNull(), F.col("_rows")).otherwise(0)).alias("null_unit"),
        F.count_if(F.col("_known").isNull()).alias("lost"),
        F.least(*[F.sum(f"_in_{arm}") for arm in spec.arms]).alias("smallest_arm"),
    )
    checks = [
        ("arm_page_mismatch", F.col("bad"), 0, False),
        ("repeated_exposures", F.col("dup"), 0, False),
        ("null_metric", F.col("null_metric"), 0, False),
        ("null_unit", F.col("null_unit"), 0, False),
        ("units_without_dimension", F.col("lost"), 0, False),
        ("date_present", F.lit(int(has_date)), 1, True),
        ("planned_sample_reached", F.col("smallest_arm"), planned_n, True),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                value.cast("bigint").alias("value"),
                F.lit(limit).cast("bigint").alias("threshold"),
                (value >= limit if at_least else value <= limit).alias("passed"),
            )
            for name, value, limit, at_least in checks
        ]
    )
    return totals.select(*spec.keys, F.inline(rows))


def mismatch_share(log: DataFrame, spec: ExperimentSpec) -> DataFrame:
    counts = mismatch_counts(log, spec)
    return counts.withColumn("mismatch_rate", ratio(F.col("mismatch_total"), F.col("n_rows")))

"""Grouped moments of a metric by arm: the sufficient statistics all mean-based tests share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import ratio
from armscope.session import written
from armscope.spec import ExperimentSpec


@dataclass(frozen=True)
class Cells:
    """Sufficient statistics by experiment, ``by`` column, arm and metric, stored once; ``paired_arms``, and so every
    test of means and rates, takes them in place of rows. Coarser cells are sums of finer ones."""

    table: DataFrame
    by: tuple[str, ...]
    metrics: tuple[str, ...]

    def of(self, metric: str, by: Sequence[str]) -> None:
        if metric not in self.metrics or not set(by) <= set(self.by):
            raise ValueError(f"cells hold {self.metrics} by {self.by}, not {metric} by {tuple(by)}")


def cells(
    df: DataFrame, spec: ExperimentSpec, by: Sequence[str] = (), metrics: Sequence[str] | None = None
) -> Cells:
    """One scan of the rows: count, sum, mean and sum of squared deviations of each metric, by cell and arm; written."""
    names = tuple(metrics or [spec.metric])
    columns = []
    for m in names:
        y = F.col(m).cast("double")
        columns += [
            F.count(m).alias(f"{m}_n"), F.sum(m).alias(f"{m}_total"), F.avg(y).alias(f"{m}_mean"),
            (F.var_pop(y) * F.count(m)).alias(f"{m}_spread"),
        ]
    grouped = df.groupBy(*spec.keys, *by, F.col(spec.arm).alias("_arm")).agg(*columns)
    return Cells(written(grouped, "cells"), tuple(by), names)


def _merged(stored: Cells, spec: ExperimentSpec, metric: str, by: Sequence[str]) -> DataFrame:
    """(keys, by, _arm, n, total, mean, var): cells put together; spreads about their own means add up by the distance
    of those from the common mean, so that nothing cancels."""
    stored.of(metric, by)
    n, total, mean, spread = (F.col(f"{metric}_{c}") for c in ("n", "total", "mean", "spread"))
    key = [*spec.keys, *by, "_arm"]
    common = stored.table.groupBy(*key).agg(F.sum(n).alias("n"), F.sum(total).alias("total"))
    common = common.withColumn("mean", ratio(F.col("total").cast("double"), F.col("n"))).withColumn("_key", F.struct(*key))
    apart = stored.table.select(F.struct(*key).alias("_key"), n.alias("_n"), mean.alias("_mean"), spread.alias("_spread"))
    both = common.join(apart, "_key")
    off = F.col("_mean") - F.col("mean")
    spreads = both.groupBy("_key").agg(F.sum(F.col("_spread") + F.col("_n") * off * off).alias("_all"))
    out = common.join(spreads, "_key")
    return out.withColumn("var", ratio(F.col("_all"), F.when(F.col("n") > 1, F.col("n") - 1)))


def arm_summary(
    df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Count, sum, mean and percentage of the metric by arm and any further columns."""
    y = F.col(metric or spec.metric)
    return (
        df.groupBy(*spec.keys, *by, F.col(spec.arm).alias("arm"))
        .agg(F.count(y).alias("n"), F.sum(y).alias("total"), F.avg(y).alias("mean"))
        .withColumn("mean_pct", F.col("mean") * 100)
    )


def arm_moments(
    df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Count, mean, sample standard deviation and both variances by arm."""
    y = F.col(metric or spec.metric).cast("double")
    return df.groupBy(*spec.keys, *by, F.col(spec.arm).alias("arm")).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("sd"),
        F.var_samp(y).alias("var_samp"),
        F.var_pop(y).alias("var_pop"),
    )


def paired_arms(
    df: DataFrame | Cells,
    spec: ExperimentSpec,
    metric: str | None = None,
    by: Sequence[str] = (),
    where: Column | None = None,
    moments: bool = True,
) -> DataFrame:
    """One row per experiment, ``by`` cell and treatment: n, total, mean and variance of both arms.

    A single aggregate serves all arms (``_c`` control, ``_t`` treatment); an arm without rows has
    n = 0 and null moments. Tests on counts need no ``moments``.
    """
    y = F.col(metric or spec.metric)
    if where is not None:
        y = F.when(where, y)
    # Count data keep exact integer totals.
    stats = {"n": F.count, "total": F.sum}
    if moments:
        stats["mean"] = lambda c: F.avg(c.cast("double"))
        stats["var"] = lambda c: F.var_samp(c.cast("double"))
    columns = []
    if isinstance(df, Cells):
        if where is not None:
            raise ValueError("cells are not told apart by a condition on rows")
        df = _merged(df, spec, metric or spec.metric, by)
        for i, arm in enumerate(spec.arms):
            mine = F.col("_arm") == arm  # one row an arm
            columns += [F.max(F.when(mine, F.col(name))).alias(f"_{name}_{i}") for name in stats]
            columns[-len(stats)] = F.coalesce(F.max(F.when(mine, F.col("n"))), F.lit(0)).alias(f"_n_{i}")
    else:
        for i, arm in enumerate(spec.arms):
            mine = F.when(F.col(spec.arm) == arm, y)
            columns += [fn(mine).alias(f"_{name}_{i}") for name, fn in stats.items()]
    cells = df.groupBy(*spec.keys, *by).agg(*columns)
    treatments = F.array(
        *[
            F.struct(
                F.lit(arm).alias("treatment"), *[F.col(f"_{name}_{i}").alias(f"{name}_t") for name in stats]
            )
            for i, arm in enumerate(spec.treatments, start=1)
        ]
    )
    return cells.select(
        *spec.keys, *by, *[F.col(f"_{name}_0").alias(f"{name}_c") for name in stats], F.inline(treatments)
    )


def arm_columns(
    df: DataFrame, spec: ExperimentSpec, metric: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Wide lookup: one row per cell with the n and mean of every arm as columns."""
    y = F.col(metric or spec.metric)
    columns = []
    for arm in spec.arms:
        mine = F.when(F.col(spec.arm) == arm, y)
        columns += [F.count(mine).alias(f"{arm}_n"), F.avg(mine).alias(f"{arm}_mean")]
    return df.groupBy(*spec.keys, *by).agg(*columns)


def pooled_moments(
    df: DataFrame, spec: ExperimentSpec, y: str, x: str, by: Sequence[str] = ()
) -> DataFrame:
    """Variances and covariance of two columns over all units, sample and population form."""
    cy, cx = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*spec.keys, *by).agg(
        F.count(cy).alias("n"),
        F.avg(cy).alias("mean_y"),
        F.avg(cx).alias("mean_x"),
        F.var_samp(cy).alias("var_samp_y"),
        F.var_pop(cy).alias("var_pop_y"),
        F.var_pop(cx).alias("var_pop_x"),
        F.covar_samp(cy, cx).alias("covar_samp"),
    )


def class_ratio(df: DataFrame, spec: ExperimentSpec, label: str | None = None) -> DataFrame:
    """Negatives, positives and their ratio, the positive class weight of a boosted model."""
    y = F.col(label or spec.metric)
    return (
        df.groupBy(*spec.keys)
        .agg(F.count_if(y == 0).alias("n_negative"), F.count_if(y == 1).alias("n_positive"))
        .withColumn("ratio", ratio(F.col("n_negative"), F.col("n_positive")))
    )


def share_of_total(df: DataFrame, value: str, out: str = "share", by: Sequence[str] = ()) -> DataFrame:
    """Value divided by its total, for small result tables."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn(out, F.coalesce(ratio(F.col(value), total), F.lit(0.0)))

"""Time buckets by arm and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import ratio
from armscope.functions.timing import BUCKET_MINUTES, LAST_MINUTE, bucket_label, half_open_bucket
from armscope.operators.joins import attach_per_group
from armscope.operators.summaries import paired_arms
from armscope.spec import ExperimentSpec


def bucket_rates(
    df: DataFrame,
    spec: ExperimentSpec,
    metric: str | None = None,
    compat: bool = False,
    width: int = BUCKET_MINUTES,
    last: int = LAST_MINUTE,
    overflow: bool = False,
) -> DataFrame:
    """Conversion by half-open bucket of ``width`` minutes and arm, in percent, with the point difference.

    Rows at or past ``last`` minutes are in no bucket, or with ``overflow`` in one of their own.

    Descriptive only where the treatment can shift the time itself. An arm without rows in a bucket
    has a null rate, or 0 in compat mode.
    """
    minutes = F.col(spec.time) / 60
    low = half_open_bucket(minutes, width, last)
    if overflow:
        low = F.when(minutes >= last, F.lit(last)).otherwise(low)
    bucketed = df.withColumn("bucket_low", low).filter(F.col("bucket_low").isNotNull())
    cells = paired_arms(bucketed, spec, metric, ("bucket_low",))
    control, treatment = F.col("mean_c") * 100, F.col("mean_t") * 100
    if compat:
        control, treatment = F.coalesce(control, F.lit(0.0)), F.coalesce(treatment, F.lit(0.0))
    return cells.select(
        *spec.keys,
        "treatment",
        "bucket_low",
        F.when(F.col("bucket_low") >= last, F.lit(f"{last}+"))
        .otherwise(bucket_label(F.col("bucket_low"), width))
        .alias("bucket"),
        "n_c",
        "n_t",
        control.alias("control_pct"),
        treatment.alias("treatment_pct"),
        (treatment - control).alias("diff_pp"),
    )


def histogram(
    df: DataFrame, spec: ExperimentSpec, value: str, bins: int = 60, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width density histogram by arm; both arms share the edges of their experiment.

    The top edge belongs to the last bin. Empty bins have no row.
    """
    groups = [*spec.keys, *by]
    data = df.select(*groups, F.col(spec.arm).alias("arm"), F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull()
    )
    edges = data.groupBy(*groups).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    placed = attach_per_group(data, edges, groups)
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width)), F.lit(0))
    counted = (
        placed.withColumn("bin", F.least(slot, F.lit(bins - 1)).cast("int"))
        .groupBy(*groups, "arm", "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*groups, "arm"))
    return counted.select(
        *groups,
        "arm",
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_low"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_high"),
        "n",
        ratio(F.col("n"), total * width).alias("density"),
    )

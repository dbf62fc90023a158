"""Rank statistics that need no global sort in one task.

Equal values are first compressed to one row with its counts. Cut points of one mergeable sketch over the distinct
values make slices, a pure function of the value, so a group of any size spreads over many of them; a running sum
inside each slice plus the total of all slices before it gives the running sum of the group. Nothing is run or
written before the action.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import at_least, at_most, ratio, verdict
from armscope.functions.tails import kolmogorov_tail, normal_cdf, two_sided_p
from armscope.operators.arms import each_treatment
from armscope.spec import ExperimentSpec


def slice_of(value: Column, cuts: Column, coarse: Column, width: int) -> Column:
    """How many of ``cuts`` (ascending) are below ``value``: first among every ``width``-th cut, then between two of them."""
    below = F.size(F.filter(coarse, lambda c: c < value))
    return below * width + F.size(F.filter(F.slice(cuts, below * width + 1, F.lit(width)), lambda c: c < value))


def running_sums(
    rows: DataFrame, groups: Sequence[str], order: str, sums: Sequence[str], slices: int | None = None
) -> DataFrame:
    """Add ``<col>_before``, the total over smaller ``order`` values in the group, and ``<col>_total``.

    ``order`` is a number, unique per group; nulls come first. A slice holds about a share 1/``slices`` of all
    rows, whatever their groups, so no part of a group is larger.
    """
    groups, sums = list(groups), list(sums)
    slices = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, math.isqrt(slices))
    marks = F.array(*[F.lit(i / slices) for i in range(1, slices)]) if slices > 1 else F.array(F.lit(0.5))
    sketch = F.percentile_approx(order, marks, F.lit(max(1000, 20 * slices)))
    cuts = rows.agg(F.array_sort(F.coalesce(sketch, F.array())).alias("cuts")).select(
        F.struct("cuts", F.filter("cuts", lambda _, i: (i + 1) % width == 0).alias("coarse"))
    )
    # one row: a scalar subquery, evaluated with the action
    known = rows.withColumn("_cuts", cuts.scalar())
    number = slice_of(F.col(order), F.col("_cuts.cuts"), F.col("_cuts.coarse"), width)
    number = F.when(F.col(order).isNotNull(), number).otherwise(F.lit(0))
    # one column that holds the keys: its comparison matches nulls, and rows stay where the window wants them
    key = F.struct(*groups, "_slice").alias("_key")
    sliced = known.withColumn("_slice", number).drop("_cuts").select("*", key)
    # At most groups x slices rows.
    totals = sliced.groupBy("_key").agg(*[F.sum(c).alias(c) for c in sums])
    whole = Window.partitionBy(*[f"_key.{g}" for g in groups])
    earlier = whole.orderBy("_key._slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_key",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_offset") for c in sums],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums],
    )
    inside = Window.partitionBy("_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumns({f"_{c}_local": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return local.join(offsets, "_key").select(
        *rows.columns,
        *[(F.col(f"_{c}_local") + F.col(f"_{c}_offset")).alias(f"{c}_before") for c in sums],
        *[f"{c}_total" for c in sums],
    )


def compressed(df: DataFrame, groups: Sequence[str], value: str, counts: Mapping[str, Column]) -> DataFrame:
    """One row per (group, value) with conditional counts; null values are left out."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("value"))
        .agg(*[F.count_if(condition).alias(name) for name, condition in counts.items()])
    )


def rank_sums(df: DataFrame, groups: Sequence[str], value: str, first: Column, second: Column) -> DataFrame:
    """Mann-Whitney U of ``first`` against ``second`` rows in each group, with the tie-corrected z.

    The deviation from the mean loses half a rank to the continuity correction. Null z where all
    values are equal or one side is empty.
    """
    counts = compressed(df, groups, value, {"c1": first, "c2": second}).filter("c1 + c2 > 0")
    ranked = running_sums(counts.withColumn("c", F.col("c1") + F.col("c2")), groups, "value", ["c"])
    c = F.col("c").cast("double")
    totals = ranked.groupBy(*groups).agg(
        F.sum("c1").alias("n1"),
        F.sum("c2").alias("n2"),
        F.sum(F.col("c1") * (F.col("c_before") + (c + 1) / 2)).alias("rank_sum"),
        F.sum(c * c * c - c).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    out = totals.withColumns(
        {
            "u": F.col("rank_sum") - n1 * (n1 + 1) / 2,
            "sigma": F.sqrt(n1 * n2 / 12 * ((n + 1) - ratio(F.col("_ties"), n * (n - 1)))),
        }
    )
    shift = at_least(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, 0.0)
    out = out.withColumn("z", ratio(shift, F.col("sigma")))
    return out.withColumn("p_value", at_most(two_sided_p(F.col("z")), 1.0)).drop("_ties")


@each_treatment
def mann_whitney(
    df: DataFrame, spec: ExperimentSpec, value: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Control against the first treatment, per experiment and ``by`` cell."""
    out = rank_sums(
        df,
        [*spec.keys, *by],
        value or spec.time,
        F.col(spec.arm) == spec.control,
        F.col(spec.arm) == spec.treatments[0],
    )
    return out.withColumn("verdict", verdict(F.col("p_value"), spec.alpha))


def auc(df: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve: the U of positives against negatives over n1 * n0."""
    out = rank_sums(df, groups, score, F.col(label) == 1, F.col(label) == 0)
    return out.select(
        *groups,
        F.col("n1").alias("n_positive"),
        F.col("n2").alias("n_negative"),
        ratio(F.col("u"), F.col("n1").cast("double") * F.col("n2")).alias("auc"),
    )


def mid_ranks(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Each distinct value with its count and mid-rank (mean rank of its ties)."""
    counts = compressed(df, groups, value, {"c": F.lit(True)})
    return running_sums(counts, groups, "value", ["c"]).select(
        *groups,
        "value",
        F.col("c").alias("n"),
        (F.col("c_before") + (F.col("c") + 1) / 2).alias("mid_rank"),
    )


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, c): how often each value occurs; 0 for null, which keeps a group that has no other."""
    counted = df.groupBy(*groups, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    return counted.withColumn("c", F.when(F.col("value").isNotNull(), F.col("c")).otherwise(0))


def _quantile_picks(probabilities: Mapping[str, float]) -> tuple[list[Column], list[Column]]:
    """Aggregates over ranked value counts, and the quantiles made of them, with linear interpolation."""
    picks, out = [], []
    for n, q in probabilities.items():
        position = (F.col("c_total") - 1) * F.lit(float(q))
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            held = (F.col("c_before") <= index) & (index < F.col("c_before") + F.col("c"))
            picks.append(F.max(F.when(held, F.col("value"))).alias(f"_{n}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{n}_frac"))
        out.append((F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_frac")).alias(n))
    return picks, out


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation; no task buffers the values of a group. No values: nulls."""
    ranked = running_sums(value_counts(df, groups, value), groups, "value", ["c"])
    picks, out = _quantile_picks(probabilities)
    return ranked.groupBy(*groups).agg(*picks).select(*groups, *out)


def _moments(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(_key, n, mean, sd) of value counts, from their weighted sums about the least value of the group."""
    v, c = F.col("value").cast("double"), F.col("c").cast("double")
    base = rows.groupBy(*groups).agg(F.min("value").cast("double").alias("_base"))
    # the least value shifts the sums, so that a large mean does not swallow a small spread
    shifted = rows.select(F.struct(*groups).alias("_key"), v.alias("_v"), c.alias("_c")).join(
        base.select(F.struct(*groups).alias("_key"), "_base"), "_key"
    )
    d = F.col("_v") - F.col("_base")
    sums = shifted.groupBy("_key").agg(
        F.sum("_c").alias("n"), F.sum(F.col("_c") * d).alias("s1"), F.sum(F.col("_c") * d * d).alias("s2"), F.max("_base").alias("_base")
    )
    n, s1 = F.col("n"), F.col("s1")
    spread = at_least(F.col("s2") - ratio(s1 * s1, n), 0.0)
    return sums.select(
        "_key", n.cast("bigint").alias("n"), (F.col("_base") + ratio(s1, n)).alias("mean"),
        F.sqrt(ratio(spread, F.when(n > 1, n - 1))).alias("sd"),
    )


def described(df: DataFrame, groups: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """(groups, n, mean, sd, min, max, the quantiles) of a column, all from one scan and its value counts.

    A group whose values are all null has n 0 and nulls.
    """
    counts = value_counts(df.withColumn("value", F.col(value).cast("double")), groups, "value")
    ranked = running_sums(counts, groups, "value", ["c"])
    picks, out = _quantile_picks(probabilities)
    placed = ranked.groupBy(*groups).agg(F.min("value").alias("min"), F.max("value").alias("max"), *picks)
    both = placed.withColumn("_key", F.struct(*groups)).join(_moments(counts, groups), "_key")
    return both.select(*groups, "n", "mean", "sd", "min", *out, "max")


def describe(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """count, mean, sd, min, quartiles and max of a column per group; a group of nulls only has n 0."""
    return described(df, groups, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def approximate_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: Mapping[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Sketch-based quantiles, one pass, for dashboards that need no exact value."""
    return df.groupBy(*groups).agg(
        *[F.percentile_approx(value, q, accuracy).alias(n) for n, q in probabilities.items()]
    )


def distinct_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Exact number of distinct non-null values, from value-compressed rows."""
    return (
        compressed(df, groups, value, {"c": F.lit(True)})
        .groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").alias("n"))
    )


def normality(df: DataFrame, spec: ExperimentSpec, value: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Kolmogorov-Smirnov distance of each arm to the normal law with its own mean and sd.

    The p-value is the limit law's. Mean and sd come from the same data, so it is too large to
    gate a decision; ``ks`` itself is exact.
    """
    value = value or spec.time
    data = df.select(*spec.keys, *by, F.col(spec.arm).alias("arm"), F.col(value).cast("double").alias("value"))
    groups = [*spec.keys, *by, "arm"]
    counts = value_counts(data, groups, "value")
    ranked = running_sums(counts, groups, "value", ["c"])
    moments = _moments(counts, groups).drop("n")
    rows = ranked.withColumn("_key", F.struct(*groups)).join(moments, "_key")
    rows = rows.withColumn("_standard", ratio(F.col("value") - F.col("mean"), F.col("sd")))
    rows = rows.withColumn("_law", normal_cdf(F.col("_standard")))
    below = F.abs(ratio(F.col("c_before"), F.col("c_total")) - F.col("_law"))
    upto = F.abs(ratio(F.col("c_before") + F.col("c"), F.col("c_total")) - F.col("_law"))
    out = rows.groupBy(*groups).agg(
        F.max("c_total").alias("n"),
        F.max("mean").alias("mean"),
        F.max("sd").alias("sd"),
        F.max(F.greatest(below, upto)).alias("ks"),
    )
    out = out.withColumn("p_value", kolmogorov_tail(F.sqrt(F.col("n")) * F.col("ks")))
    return out.withColumn("normal", F.col("p_value") > spec.alpha)

"""Assignment audits: splits, layers, A/A replicates, sample ratio and balance, clusters, interleaving."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import at_least, ratio
from armscope.functions.hashing import hash_arm, split_arm
from armscope.functions.tails import chi_square_tail, two_sided_p
from armscope.operators.arms import each_treatment
from armscope.operators.means import welch_t
from armscope.operators.proportions import two_proportion_z
from armscope.spec import ExperimentSpec


def split_counts(
    units: DataFrame, unit: str, salt: str, splits: Mapping[str, Sequence[tuple[str, float]]]
) -> DataFrame:
    """Units per arm for several traffic splits at once."""
    chosen = F.array(
        *[
            F.struct(F.lit(name).alias("split"), split_arm(salt, F.col(unit), shares).alias("arm"))
            for name, shares in splits.items()
        ]
    )
    counted = units.select(F.inline(chosen)).groupBy("split", "arm").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


def contingency_chi_square(cells: DataFrame, groups: Sequence[str], row: str, column: str, n: str = "n") -> DataFrame:
    """Chi-square of independence from long counts (group, row, column, n); absent cells count 0."""
    groups = list(groups)
    rows = Window.partitionBy(*groups, row)
    columns = Window.partitionBy(*groups, column)
    whole = Window.partitionBy(*groups)
    c = cells.withColumns(
        {
            "_r": F.sum(n).over(rows),
            "_k": F.sum(n).over(columns),
            "_all": F.sum(n).over(whole),
        }
    )
    # sum (o-e)^2/e = N (sum o^2/(r k) - 1), to which empty cells add nothing.
    out = c.groupBy(*groups).agg(
        F.max("_all").alias("n"),
        F.count_distinct(row).alias("n_rows"),
        F.count_distinct(column).alias("n_columns"),
        F.sum(F.col(n).cast("double") * F.col(n) / (F.col("_r") * F.col("_k").cast("double"))).alias("_q"),
    )
    out = out.withColumns(
        {
            "chi2": F.col("n") * (F.col("_q") - 1),
            "df": (F.col("n_rows") - 1) * (F.col("n_columns") - 1),
        }
    )
    return out.withColumn("p_value", chi_square_tail(at_least(F.col("chi2"), 0.0), F.col("df"))).drop("_q")


def layer_independence(units: DataFrame, unit: str, salts: Sequence[str]) -> DataFrame:
    """Chi-square of every pair of layers: orthogonal layers show no association.

    A unit is one vector of zeros and ones, 1 where the layer gives it the control. Tasks add up the products of
    those vectors, one matrix of layers by layers each; no row is copied for a pair.
    """
    names = list(salts)
    control = lambda salt: (hash_arm(salt, F.col(unit)) == "control").cast("int")
    vectors = units.select(F.transform(F.array(*[F.lit(s) for s in names]), control).alias("x"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((len(names), len(names)))
        for batch in batches:
            m = np.stack(batch["x"].to_numpy()).astype(np.float64)
            n, both = n + len(m), both + m.T @ m
        if n:
            yield pd.DataFrame({"i": range(len(names)), "n": n, "row": list(both.astype(np.int64))})

    # one column at a time: the counts of layer i with every layer
    partial = vectors.mapInPandas(add, "i int, n bigint, row array<bigint>")
    cells = partial.select("i", "n", F.posexplode("row").alias("j", "c")).where("j >= i").groupBy("i", "j").agg(
        F.sum("c").alias("both"), F.sum("n").alias("n")
    )
    alone = cells.where("i = j").select(F.col("i").alias("k"), F.col("both").alias("s"))
    pairs = (
        cells.where("i < j").join(alone.select(F.col("k").alias("i"), F.col("s").alias("s_i")), "i")
        .join(alone.select(F.col("k").alias("j"), F.col("s").alias("s_j")), "j")
    )
    d = lambda c: F.col(c).cast("double")
    n, s_i, s_j, both = d("n"), d("s_i"), d("s_j"), d("both")
    # (a d - b c) of the two by two table
    cross = both * (n - s_i - s_j + both) - (s_i - both) * (s_j - both)
    name = lambda c: F.array(*[F.lit(s) for s in names])[F.col(c)]
    sides = lambda s: F.when((s > 0) & (s < n), 2).otherwise(1).cast("bigint")
    out = pairs.select(
        name("i").alias("layer_a"), name("j").alias("layer_b"), "n", sides(s_i).alias("n_rows"), sides(s_j).alias("n_columns"),
        F.coalesce(ratio(n * cross * cross, s_i * (n - s_i) * s_j * (n - s_j)), F.lit(0.0)).alias("chi2"),
    )
    out = out.withColumn("df", (F.col("n_rows") - 1) * (F.col("n_columns") - 1))
    return out.withColumn("p_value", chi_square_tail(F.col("chi2"), F.col("df")))


def aa_replicates(units: DataFrame, spec: ExperimentSpec, salts: Sequence[str]) -> DataFrame:
    """The z test on arms redrawn with each salt: no effect exists, so p-values should be uniform.

    Rows are expanded by salt and combined before the shuffle.
    """
    redrawn = units.select(
        *spec.keys, spec.unit, spec.metric, F.explode(F.array(*[F.lit(s) for s in salts])).alias("salt")
    ).withColumn(spec.arm, hash_arm(F.col("salt"), F.col(spec.unit)))
    return two_proportion_z(redrawn, spec, by=["salt"])


def aa_summary(replicates: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Share of replicates below alpha, expected near alpha."""
    return replicates.groupBy(*spec.keys).agg(
        F.count("p_value").alias("n_replicates"),
        F.count_if(F.col("p_value") < spec.alpha).alias("n_significant"),
        F.avg((F.col("p_value") < spec.alpha).cast("double")).alias("false_positive_rate"),
        F.min("p_value").alias("min_p"),
        F.max("p_value").alias("max_p"),
    )


def sample_ratio(
    units: DataFrame,
    spec: ExperimentSpec,
    shares: Mapping[str, float] | None = None,
    by: Sequence[str] = (),
    alarm: float = 0.001,
) -> DataFrame:
    """Chi-square of observed arm sizes against planned shares (the spec's by default)."""
    shares = shares or spec.planned_shares
    total_share = sum(shares.values())
    counts = units.groupBy(*spec.keys, *by).agg(
        *[F.count_if(F.col(spec.arm) == arm).alias(f"n_{arm}") for arm in shares]
    )
    n = sum((F.col(f"n_{arm}") for arm in shares), F.lit(0))
    terms = []
    for arm, share in shares.items():
        expected = n * (share / total_share)
        terms.append(ratio((F.col(f"n_{arm}") - expected) * (F.col(f"n_{arm}") - expected), expected))
    chi2 = terms[0]
    for term in terms[1:]:
        chi2 = chi2 + term
    out = counts.withColumn("chi2", chi2)
    out = out.withColumn("p_value", chi_square_tail(F.col("chi2"), F.lit(len(shares) - 1)))
    return out.withColumn("mismatch_alarm", F.col("p_value") < alarm)


def stratum_balance(units: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Chi-square of stratum against arm: are the arms alike in composition?"""
    cells = units.groupBy(*spec.keys, spec.stratum, F.col(spec.arm).alias("arm")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return contingency_chi_square(cells, spec.keys, spec.stratum, "arm")


@each_treatment
def standardised_differences(units: DataFrame, spec: ExperimentSpec, covariates: Sequence[str]) -> DataFrame:
    """(mean treatment - mean control) / pooled sd for each covariate, from one scan."""
    columns = []
    for i, name in enumerate(covariates):
        for suffix, arm in (("c", spec.control), ("t", spec.treatments[0])):
            mine = F.when(F.col(spec.arm) == arm, F.col(name).cast("double"))
            columns += [F.avg(mine).alias(f"_m{suffix}{i}"), F.var_samp(mine).alias(f"_v{suffix}{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("covariate"),
                F.col(f"_mc{i}").alias("mean_c"),
                F.col(f"_mt{i}").alias("mean_t"),
                ratio(
                    F.col(f"_mt{i}") - F.col(f"_mc{i}"), F.sqrt((F.col(f"_vc{i}") + F.col(f"_vt{i}")) / 2)
                ).alias("smd"),
            )
            for i, name in enumerate(covariates)
        ]
    )
    return units.groupBy(*spec.keys).agg(*columns).select(*spec.keys, F.inline(rows))


def cluster_effect(
    units: DataFrame, clusters: DataFrame, spec: ExperimentSpec, salt: str, metric: str | None = None,
    p_values: bool = True,
) -> DataFrame:
    """Whole clusters are assigned by hash; the test compares cluster means.

    ``clusters`` maps unit to ``cluster``.
    """
    metric = metric or spec.metric
    outcomes = units.join(clusters, spec.unit).groupBy(*spec.keys, "cluster").agg(
        F.avg(metric).alias("cluster_mean"), F.count(metric).alias("cluster_size")
    )
    assigned = outcomes.withColumn(spec.arm, hash_arm(salt, F.col("cluster"), spec.arms))
    return welch_t(assigned, spec, "cluster_mean", p_values=p_values)


def spillover_boundary(
    units: DataFrame, edges: DataFrame, spec: ExperimentSpec, metric: str | None = None
) -> DataFrame:
    """Units with a neighbour in another arm (boundary) against those without (core), per arm.

    ``edges`` has ``src`` and ``dst``, each pair once or in both directions. Both joins run on keys;
    the neighbours of a unit are combined before the shuffle, so a unit may have very many.
    """
    metric = metric or spec.metric
    both_ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    arms = units.select(*spec.keys, spec.unit, F.col(spec.arm).alias("arm"))
    neighbour_arm = arms.select(*spec.keys, F.col(spec.unit).alias("dst"), F.col("arm").alias("other_arm"))
    seen = (
        both_ways.join(neighbour_arm, "dst")
        .groupBy(*spec.keys, F.col("src").alias(spec.unit))
        .agg(F.collect_set("other_arm").alias("_neighbour_arms"))
    )
    placed = units.join(seen, [*spec.keys, spec.unit], "left")
    others = F.size(F.array_remove(F.coalesce("_neighbour_arms", F.array().cast("array<string>")), F.col(spec.arm)))
    return (
        placed.withColumn("position", F.when(others > 0, "boundary").otherwise("core"))
        .groupBy(*spec.keys, F.col(spec.arm).alias("arm"), "position")
        .agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"))
        .withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*spec.keys, "arm")))
    )


def interleaving(clicks: DataFrame, spec: ExperimentSpec, list_column: str, first: str, second: str) -> DataFrame:
    """Clicks on two mixed lists compared within each unit: paired z and sign test, first minus second."""
    per_unit = clicks.groupBy(*spec.keys, spec.unit).agg(
        F.count_if(F.col(list_column) == first).alias("_a"), F.count_if(F.col(list_column) == second).alias("_b")
    )
    d = (F.col("_a") - F.col("_b")).cast("double")
    out = per_unit.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("n_units"),
        F.sum("_a").alias("clicks_first"),
        F.sum("_b").alias("clicks_second"),
        F.avg(d).alias("mean_diff"),
        F.stddev_samp(d).alias("sd_diff"),
        F.count_if(d > 0).alias("wins_first"),
        F.count_if(d < 0).alias("wins_second"),
    )
    wins, losses = F.col("wins_first"), F.col("wins_second")
    out = out.withColumns(
        {
            "z": ratio(F.col("mean_diff") * F.sqrt(F.col("n_units")), F.col("sd_diff")),
            "sign_z": ratio(wins - losses, F.sqrt(wins + losses)),
        }
    )
    return out.withColumns({"p_value": two_sided_p(F.col("z")), "sign_p_value": two_sided_p(F.col("sign_z"))})

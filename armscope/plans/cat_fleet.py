"""Catalogue: many experiments in one pass, and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.operators import design, power, proportions, ranks, variance
from armscope.plans import charts
from armscope.plans.cat_effects import _MW_COLUMNS, _Z_COLUMNS
from armscope.plans.cat_power import _CUPED_SQL, _SIZE_COLUMNS, _ZA, _ZB, _round_sizes
from armscope.plans.registry import SPEC, fleet_units, orders_units, prepost_units, query, rounded
from armscope.plans.sqltext import FLEET_UNITS, ORDERS_UNITS, PREPOST, div, mid_ranked, p_two, paired, r, rs, z_test


@query(
    "st02_fleet_z",
    f"WITH {FLEET_UNITS}, cells AS ({paired('u', 'converted')}), {z_test('cells')} SELECT experiment, treatment, {_Z_COLUMNS} FROM zt",
)
def fleet_z(spark, sf_dir):
    """All experiments of the log in one grouped scan."""
    return rounded(proportions.two_proportion_z(fleet_units(spark, sf_dir), SPEC))


@query(
    "st05_fleet_stratified_z",
    f"WITH {FLEET_UNITS}, cells AS ({paired('u', 'converted', 'country')}), {z_test('cells')} SELECT experiment, country, treatment, {_Z_COLUMNS} FROM zt",
)
def fleet_strata(spark, sf_dir):
    return rounded(proportions.stratified_z(fleet_units(spark, sf_dir), SPEC))


@query(
    "st08_fleet_mann_whitney",
    f"WITH {FLEET_UNITS}, {mid_ranked('u', 'amount')} SELECT experiment, {_MW_COLUMNS} FROM mw",
)
def fleet_ranks(spark, sf_dir):
    return rounded(ranks.mann_whitney(fleet_units(spark, sf_dir), SPEC, "amount"))


@query(
    "ag07_fleet_describe",
    f"""WITH {FLEET_UNITS} SELECT experiment, arm, count(amount) AS n, {rs('mean=avg(amount)', 'sd=stddev_samp(amount)', 'min=min(amount)',
 'q25=quantile_cont(amount, 0.25)', 'q50=quantile_cont(amount, 0.5)', 'q75=quantile_cont(amount, 0.75)', 'max=max(amount)')}
FROM u GROUP BY experiment, arm""",
)
def fleet_describe(spark, sf_dir):
    units = fleet_units(spark, sf_dir).withColumn("arm", F.col("group"))
    return rounded(ranks.describe(units, ["experiment", "arm"], "amount"))


_ONE_EMPTY = "CASE WHEN experiment = '1-URGENT' AND {arm} = 'control' THEN NULL ELSE amount END"


@query(
    "ag07_null_group",
    f"""WITH {FLEET_UNITS}, v AS (SELECT experiment, arm, {_ONE_EMPTY.format(arm='arm')} AS amount FROM u)
SELECT experiment, arm, count(amount) AS n, {rs('mean=avg(amount)', 'sd=stddev_samp(amount)', 'min=min(amount)',
 'q25=quantile_cont(amount, 0.25)', 'q50=quantile_cont(amount, 0.5)', 'q75=quantile_cont(amount, 0.75)', 'max=max(amount)')}
FROM v GROUP BY experiment, arm""",
)
def null_group(spark, sf_dir):
    """A group whose values are all null stays, with n 0."""
    units = fleet_units(spark, sf_dir).withColumn("arm", F.col("group"))
    units = units.withColumn("amount", F.expr(_ONE_EMPTY.format(arm="arm")))
    return rounded(ranks.describe(units, ["experiment", "arm"], "amount"))


@query(
    "st17_fleet_sample_sizes",
    f"""WITH {FLEET_UNITS}, cells AS ({paired('u', 'converted')}),
b AS (SELECT experiment, treatment, mean_c AS baseline, least(n_c, n_t) AS current_n FROM cells),
g AS (SELECT *, unnest([0.01, 0.02, 0.05, 0.1]::double[]) AS mde FROM b),
h AS (SELECT *, baseline * mde * 100 AS mde_pp, CASE WHEN baseline * (1 + mde) <= 1
  THEN 2 * asin(sqrt(baseline)) - 2 * asin(sqrt(baseline * (1 + mde))) END AS h FROM g),
n AS (SELECT *, {div(repr(2 * (_ZA + _ZB) ** 2), 'h * h')} AS n_required FROM h)
SELECT experiment, {_SIZE_COLUMNS} FROM n""",
)
def fleet_sizes(spark, sf_dir):
    return _round_sizes(power.sample_sizes(power.baselines(fleet_units(spark, sf_dir), SPEC), SPEC))


@query(
    "mb08_fleet_sample_ratio",
    f"""WITH {FLEET_UNITS},
c AS (SELECT experiment, count(*) FILTER (arm = 'control') AS n_control, count(*) FILTER (arm = 'treatment') AS n_treatment FROM u GROUP BY ALL),
x AS (SELECT *, (n_control - n_treatment) ** 2 / (n_control + n_treatment)::double AS chi2 FROM c),
y AS (SELECT *, sqrt(chi2) AS z FROM x), q AS (SELECT *, {p_two('z')} AS p_value FROM y)
SELECT experiment, n_control, n_treatment, {rs('chi2', 'p_value')}, p_value < 0.001 AS mismatch_alarm FROM q""",
)
def fleet_ratio(spark, sf_dir):
    return rounded(design.sample_ratio(fleet_units(spark, sf_dir), SPEC))


@query(
    "cd01_conversion_rates",
    f"""WITH {ORDERS_UNITS}, l AS (SELECT experiment, unnest([country, 'ALL']) AS country, arm, converted FROM u)
SELECT experiment, country, arm, count(converted) AS n, cast(sum(converted) as bigint) AS total, {rs('rate_pct=avg(converted) * 100')}
FROM l GROUP BY experiment, country, arm""",
)
def cd01(spark, sf_dir):
    return rounded(charts.conversion_rates(orders_units(spark, sf_dir), SPEC))


@query(
    "cd02_interval",
    f"""WITH {ORDERS_UNITS}, cells AS ({paired('u', 'converted')}), {z_test('cells')}
SELECT experiment, treatment, {rs('diff_pp=diff * 100', 'half_width_pp=1.96 * se_diff * 100', 'p_value')} FROM zt""",
)
def cd02(spark, sf_dir):
    return rounded(charts.interval(proportions.two_proportion_z(orders_units(spark, sf_dir), SPEC), SPEC))


@query(
    "cd03_stratum_differences",
    f"""WITH {ORDERS_UNITS}, cells AS ({paired('u', 'converted', 'country')}), {z_test('cells')}
SELECT experiment, treatment, country, {rs('diff_pp=diff * 100')}, CASE WHEN diff > 0 THEN 'control_higher' ELSE 'treatment_higher' END AS colour,
 {r('(sum(total_c) OVER () / sum(n_c) OVER () - sum(total_t) OVER () / sum(n_t) OVER ()) * 100')} AS overall_diff_pp FROM zt""",
)
def cd03(spark, sf_dir):
    return rounded(
        charts.stratum_differences(proportions.stratified_z(orders_units(spark, sf_dir), SPEC), SPEC)
    )


@query(
    "cd10_adjustment_comparison",
    f"""WITH {PREPOST}, {_CUPED_SQL.format(src='pp', y='post', x='pre')}
SELECT experiment, 'original' AS method, {rs('variance=var_original', 'diff_pp=diff * 100', 'half_width_pp=1.96 * se * 100')} FROM q
UNION ALL SELECT experiment, 'adjusted', {rs('variance=var_adjusted', 'diff_pp=diff_adj * 100', 'half_width_pp=1.96 * se_adj * 100')} FROM q""",
)
def cd10(spark, sf_dir):
    return rounded(
        charts.adjustment_comparison(variance.cuped_report(prepost_units(spark, sf_dir), SPEC, "post", "pre"), SPEC)
    )

"""Catalogue: power and duration, variance reduction, multiple testing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from armscope.operators import multiple, power, sampling, variance
from armscope.operators.multiple import Metric
from armscope.plans.registry import (
    SPEC,
    events_rows,
    orders_log,
    orders_units,
    prepost_units,
    query,
    rounded,
)
from armscope.plans.sqltext import (
    EVENTS_ROWS,
    ORDERS_LOG,
    ORDERS_UNITS,
    PREPOST,
    cdf,
    div,
    hashed,
    p_two,
    paired,
    r,
    rs,
    student_p,
)

_ZA, _ZB = SPEC.z_alpha, SPEC.z_power


def _sizes(by: str = "", mdes: str = "0.01, 0.02, 0.05, 0.1") -> str:
    item = f", {by}" if by else ""
    return f"""WITH {ORDERS_UNITS}, cells AS ({paired('u', 'converted', by)}),
b AS (SELECT experiment{item}, treatment, mean_c AS baseline, least(n_c, n_t) AS current_n FROM cells),
g AS (SELECT *, unnest([{mdes}]::double[]) AS mde FROM b),
h AS (SELECT *, baseline * mde * 100 AS mde_pp, CASE WHEN baseline * (1 + mde) <= 1
  THEN 2 * asin(sqrt(baseline)) - 2 * asin(sqrt(baseline * (1 + mde))) END AS h FROM g),
n AS (SELECT *, {div(repr(2 * (_ZA + _ZB) ** 2), 'h * h')} AS n_required FROM h)"""


_SIZE_COLUMNS = f"""treatment, current_n, {rs('baseline', 'mde', 'mde_pp', 'h')}, {r('n_required', 3)} AS n_required,
 {rs(f"current_share={div('current_n', 'n_required')}")}, {r(div('n_required', 'current_n'), 4)} AS shortfall"""


def _round_sizes(df):
    df = df.withColumns({"n_required": F.round("n_required", 3), "shortfall": F.round("shortfall", 4)})
    return rounded(df)


@query("st17_sample_sizes", f"{_sizes()} SELECT experiment, {_SIZE_COLUMNS} FROM n")
def st17(spark, sf_dir):
    return _round_sizes(power.sample_sizes(power.baselines(orders_units(spark, sf_dir), SPEC), SPEC))


@query("st18_target_shortfall", f"{_sizes(mdes='0.01')} SELECT experiment, {_SIZE_COLUMNS} FROM n")
def st18(spark, sf_dir):
    return _round_sizes(power.target_shortfall(power.baselines(orders_units(spark, sf_dir), SPEC), SPEC))


@query(
    "st20_segment_power_audit", f"{_sizes('country')} SELECT experiment, country, {_SIZE_COLUMNS} FROM n"
)
def st20(spark, sf_dir):
    base = power.baselines(orders_units(spark, sf_dir), SPEC, by=["country"])
    return _round_sizes(power.sample_sizes(base, SPEC))


@query(
    "st19_power_curve",
    f"""{_sizes('country', '0.01')},
c AS (SELECT *, cast(point as int) AS pt, 10000 + point * (1990000.0::double / 99) AS m
  FROM n, range(0, 100) AS points(point)),
s AS (SELECT *, abs(h) * sqrt(m / 2) - {_ZA!r} AS a, -abs(h) * sqrt(m / 2) - {_ZA!r} AS b FROM c)
SELECT experiment, country, treatment, pt AS point, {r('m', 3)} AS n, {rs(f"power={cdf('a')} + {cdf('b')}")},
 current_n, {r('n_required', 3)} AS n_required FROM s""",
)
def st19(spark, sf_dir):
    """ST19 and CD5, per stratum, with the two marks of the chart: the current and the required n."""
    curve = power.power_curve(power.baselines(orders_units(spark, sf_dir), SPEC, by=["country"]), SPEC)
    return rounded(
        curve.select(
            "experiment", "country", "treatment", "point", F.round("n", 3).alias("n"), "power", "current_n",
            F.round("n_required", 3).alias("n_required"),
        )
    )


@query(
    "st20_achieved_power",
    f"""{_sizes('country')},
s AS (SELECT *, abs(h) * sqrt(current_n / 2) - {_ZA!r} AS a, -abs(h) * sqrt(current_n / 2) - {_ZA!r} AS b FROM n)
SELECT experiment, country, treatment, {rs('mde', f"power={cdf('a')} + {cdf('b')}")} FROM s""",
)
def st20_power(spark, sf_dir):
    base = power.baselines(orders_units(spark, sf_dir), SPEC, by=["country"])
    return rounded(
        power.achieved_power(base, SPEC).select("experiment", "country", "treatment", "mde", "power")
    )


def _duration_sql(share_c: float, share_t: float) -> str:
    return f"""{_sizes(mdes='0.05')},
t AS (SELECT experiment, avg(units) AS daily_units FROM (
  SELECT experiment, cast(ts as date) AS day, count(DISTINCT user_id) AS units FROM log GROUP BY ALL) GROUP BY experiment),
w AS (SELECT n.*, daily_units, {div(repr((_ZA + _ZB) ** 2 * (share_c + share_t)), f'h * h * {share_c * share_t!r}')} AS whole FROM n JOIN t USING (experiment)),
d AS (SELECT *, cast(ceil({div('whole', 'daily_units')}) as bigint) AS days FROM w)
SELECT experiment, treatment, {rs('mde', 'daily_units')}, {r(f'whole * {share_t}', 3)} AS n_required, {r(f'whole * {share_c}', 3)} AS n_control,
 days AS min_days, cast(greatest(ceil(days / 7.0), 1) * 7 as bigint) AS planned_days FROM d"""


def _duration(spark, sf_dir, spec):
    base = power.baselines(orders_units(spark, sf_dir), spec)
    out = power.duration_days(orders_log(spark, sf_dir), base, spec, mde=0.05)
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("n_required", "n_control")}))


@query("mb04_duration", _duration_sql(0.5, 0.5))
def mb04(spark, sf_dir):
    return _duration(spark, sf_dir, SPEC)


@query("mb04_planned_split", _duration_sql(0.9, 0.1))
def mb04_split(spark, sf_dir):
    """A plan of 90:10 waits for the small arm."""
    return _duration(spark, sf_dir, replace(SPEC, shares=(0.9, 0.1)))


_CUPED_SQL = """
m AS (
  SELECT experiment, count(*) AS n, covar_samp({y}, {x}) / var_pop({x}) AS theta, avg({x}) AS mx FROM {src} GROUP BY experiment),
adj AS (SELECT s.*, {y} - theta * ({x} - mx) AS y_adj, theta FROM {src} s JOIN m USING (experiment)),
c AS (
  SELECT experiment, any_value(theta) AS theta, var_pop({y}) AS var_original, var_pop(y_adj) AS var_adjusted,
    count(*) FILTER (arm = 'control') AS n_c, count(*) FILTER (arm = 'treatment') AS n_t,
    avg({y}) FILTER (arm = 'control') - avg({y}) FILTER (arm = 'treatment') AS diff,
    avg(y_adj) FILTER (arm = 'control') - avg(y_adj) FILTER (arm = 'treatment') AS diff_adj,
    sqrt(var_pop({y}) FILTER (arm = 'control') / count(*) FILTER (arm = 'control')
       + var_pop({y}) FILTER (arm = 'treatment') / count(*) FILTER (arm = 'treatment')) AS se,
    sqrt(var_pop(y_adj) FILTER (arm = 'control') / count(*) FILTER (arm = 'control')
       + var_pop(y_adj) FILTER (arm = 'treatment') / count(*) FILTER (arm = 'treatment')) AS se_adj
  FROM adj GROUP BY experiment),
q AS (SELECT *, diff / se AS z, diff_adj / se_adj AS z_adj FROM c)"""
_CUPED_COLUMNS = f"""n_c, n_t, {rs('theta', 'var_original', 'var_adjusted',
 'variance_reduction_pct=(1 - var_adjusted / var_original) * 100', 'diff', 'diff_adj', 'se', 'se_adj', 'z', 'z_adj',
 f"p_value={p_two('z')}", f"p_value_adj={p_two('z_adj')}", 'se_reduction_pct=(1 - se_adj / se) * 100',
 'equivalent_sample_pct=(se * se / (se_adj * se_adj) - 1) * 100')}"""


@query(
    "st25_cuped_report",
    f"""WITH {PREPOST}, {_CUPED_SQL.format(src='pp', y='post', x='pre')}
SELECT experiment, {_CUPED_COLUMNS}, true AS covariate_pre_period FROM q""",
)
def st25(spark, sf_dir):
    """ST24, ST25, CD10 with the pre-period value as covariate."""
    return rounded(variance.cuped_report(prepost_units(spark, sf_dir), SPEC, "post", "pre"))


@query(
    "st25_cuped_in_experiment_time",
    f"""WITH {EVENTS_ROWS}, {_CUPED_SQL.format(src='e', y='converted', x='time_seconds')}
SELECT experiment, {_CUPED_COLUMNS}, false AS covariate_pre_period FROM q""",
)
def st25_time(spark, sf_dir):
    """With a covariate measured during the experiment, flagged as such."""
    return rounded(
        variance.cuped_report(events_rows(spark, sf_dir), SPEC, "converted", "time_seconds", pre_period=False)
    )


@query(
    "st24_cuped_adjusted_rows",
    f"""WITH {PREPOST}, {_CUPED_SQL.format(src='pp', y='post', x='pre')}
SELECT user_id, arm, {rs('post', 'y_adj')} FROM adj""",
)
def st24(spark, sf_dir):
    adjusted = variance.cuped_adjust(prepost_units(spark, sf_dir), SPEC, "post", "pre")
    return rounded(adjusted.select("user_id", F.col("group").alias("arm"), "post", "y_adj"))


@query(
    "mb15_ancova",
    f"""WITH {PREPOST}, s AS (SELECT *, cast(arm = 'treatment' as double) AS a FROM pp),
m AS (SELECT experiment, count(*) AS n, var_pop(a) * count(*) AS saa, var_pop(pre) * count(*) AS sxx,
  var_pop(post) * count(*) AS syy, covar_pop(a, pre) * count(*) AS sax, covar_pop(a, post) * count(*) AS say,
  covar_pop(pre, post) * count(*) AS sxy FROM s GROUP BY experiment),
b AS (SELECT *, saa * sxx - sax * sax AS det, (say * sxx - sax * sxy) / (saa * sxx - sax * sax) AS effect,
  (saa * sxy - sax * say) / (saa * sxx - sax * sax) AS slope FROM m),
w AS (SELECT *, sqrt((syy - effect * say - slope * sxy) / (n - 3) * sxx / det) AS se, cast(n - 3 as double) AS df FROM b),
q AS (SELECT *, effect / se AS t FROM w)
SELECT experiment, n, {rs('effect_unadjusted=say / saa', 'effect', 'slope', 'se', 't', 'df')},
 {r(student_p('t', 'df'))} AS p_value FROM q""",
)
def mb15(spark, sf_dir):
    return rounded(variance.ancova(prepost_units(spark, sf_dir), SPEC, "post", "pre"))


@query(
    "mb16_stratified_sample",
    f"""WITH {ORDERS_UNITS}
SELECT country, user_id FROM u QUALIFY row_number() OVER (PARTITION BY experiment, country
  ORDER BY {hashed("'7' || chr(58) || user_id")}, user_id) <= 50""",
)
def mb16(spark, sf_dir):
    units = orders_units(spark, sf_dir)
    return sampling.stratified_sample(units, ["experiment"], "country", ["user_id"], 50, seed=7).select(
        "country", "user_id"
    )


@query(
    "mb16_poststratification",
    f"""WITH {ORDERS_UNITS},
p AS (SELECT experiment, country, count(*) AS n_population, count(*) FILTER (arm = 'treatment') AS n_sample FROM u GROUP BY ALL),
s AS (SELECT *, n_population / sum(n_population) OVER () AS population_share, n_sample / sum(n_sample) OVER () AS sample_share FROM p)
SELECT experiment, country, n_population, n_sample, {rs('population_share', 'sample_share', 'weight=population_share / sample_share')} FROM s""",
)
def mb16_weights(spark, sf_dir):
    """Weights that bring the treated units' country mix to that of all units."""
    units = orders_units(spark, sf_dir)
    return rounded(
        sampling.poststratification_weights(
            units.filter(F.col("group") == "treatment"), units, ["experiment"], "country"
        )
    )


METRICS = [
    Metric("post_value", "post", "primary", 1),
    Metric("purchases", "purchases", "secondary", 1),
    Metric("errors", "errors", "guardrail", -1),
    Metric("n_events", "n_events", "guardrail", 1),
]
TIER_ALPHAS = {"primary": 0.05, "secondary": 0.02, "guardrail": 0.1}
METRIC_ROWS = ", ".join(
    f"{{'metric': '{m.name}', 'role': '{m.role}', 'good': {m.good}, 'v': {m.column}::double}}" for m in METRICS
)


def metric_sql(by: str = "") -> str:
    item = f", {by}" if by else ""
    return f"""long AS (SELECT experiment{item}, arm, r.metric AS metric, r.role AS role, r.good AS good, r.v AS v
  FROM (SELECT *, unnest([{METRIC_ROWS}]) AS r FROM pp)),
mc AS (SELECT experiment{item}, metric, role, good, count(v) FILTER (arm = 'control') AS n_c,
  count(v) FILTER (arm = 'treatment') AS n_t,
  avg(v) FILTER (arm = 'treatment') - avg(v) FILTER (arm = 'control') AS effect,
  sqrt({div("var_samp(v) FILTER (arm = 'control')", "count(v) FILTER (arm = 'control')")}
     + {div("var_samp(v) FILTER (arm = 'treatment')", "count(v) FILTER (arm = 'treatment')")}) AS se
  FROM long GROUP BY ALL),
mz AS (SELECT *, {div('effect', 'se')} AS z, effect - 1.96 * se AS ci_low, effect + 1.96 * se AS ci_high FROM mc),
mt AS (SELECT *, {p_two('z')} AS p_value FROM mz)"""


@query(
    "mb18_multiple_testing",
    f"""WITH {PREPOST}, {metric_sql('country')},
k AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY p_value, country, metric) AS rk,
  count(*) OVER (PARTITION BY experiment) AS n_tests FROM mt WHERE p_value IS NOT NULL),
b AS (SELECT *, least(1.0, min(p_value * n_tests / rk) OVER (PARTITION BY experiment ORDER BY rk DESC)) AS p_bh,
  CASE role WHEN 'primary' THEN 0.05 WHEN 'secondary' THEN 0.02 WHEN 'guardrail' THEN 0.1 END AS tier_alpha FROM k)
SELECT experiment, country, metric, role, n_tests, {rs('p_value', 'p_bonferroni=least(1.0, p_value * n_tests)', 'p_bh',
 'alpha_bonferroni=0.05 / n_tests', 'family_error=1 - power(0.95, n_tests)', 'tier_alpha')},
 p_value < 0.05 AS reject_raw, p_value < 0.05 / n_tests AS reject_bonferroni, p_bh <= 0.05 AS reject_bh,
 p_value < tier_alpha AS reject_tiered FROM b""",
)
def mb18(spark, sf_dir):
    """Four metrics in every country, corrected as one family."""
    tests = multiple.metric_tests(prepost_units(spark, sf_dir), SPEC, METRICS, by=["country"])
    out = multiple.correct_p_values(
        tests, ["experiment"], SPEC.alpha, ["country", "metric"], F.col("role"), TIER_ALPHAS
    )
    return rounded(
        out.select(
            "experiment", "country", "metric", "role", "n_tests", "p_value", "p_bonferroni", "p_bh",
            "alpha_bonferroni", "family_error", "tier_alpha", "reject_raw", "reject_bonferroni",
            "reject_bh", "reject_tiered",
        )
    )


@query(
    "mb12_quasi_poisson",
    f"""WITH {PREPOST},
m AS (SELECT experiment, count(*) FILTER (arm = 'control') AS n_c, count(*) FILTER (arm = 'treatment') AS n_t,
  cast(sum(purchases) FILTER (arm = 'control') as double) AS y_c, cast(sum(purchases) FILTER (arm = 'treatment') as double) AS y_t,
  avg(purchases) FILTER (arm = 'control') AS rate_c, avg(purchases) FILTER (arm = 'treatment') AS rate_t FROM pp GROUP BY ALL),
d AS (SELECT pp.experiment, sum((purchases - CASE arm WHEN 'control' THEN rate_c ELSE rate_t END) ** 2
  / CASE arm WHEN 'control' THEN rate_c ELSE rate_t END) AS pearson FROM pp JOIN m USING (experiment) GROUP BY ALL),
q AS (SELECT m.*, pearson / (n_c + n_t - 2) AS dispersion, rate_t / rate_c AS rate_ratio, sqrt(1 / y_c + 1 / y_t) AS se_log_poisson
  FROM m JOIN d USING (experiment)),
s AS (SELECT *, se_log_poisson * sqrt(greatest(dispersion, 1)) AS se_log,
  greatest((dispersion - 1) / ((y_c + y_t) / (n_c + n_t)), 0) AS inverse_size FROM q),
z AS (SELECT *, ln(rate_ratio) / se_log AS z FROM s)
SELECT experiment, n_c, n_t, {rs('y_c', 'y_t', 'rate_c', 'rate_t', 'dispersion', 'rate_ratio', 'se_log_poisson', 'se_log',
 'inverse_size', 'z', 'ratio_low=exp(ln(rate_ratio) - 1.96 * se_log)', 'ratio_high=exp(ln(rate_ratio) + 1.96 * se_log)',
 f"p_value={p_two('z')}")} FROM z""",
)
def mb12(spark, sf_dir):
    return rounded(multiple.quasi_poisson(prepost_units(spark, sf_dir), SPEC, "purchases"))

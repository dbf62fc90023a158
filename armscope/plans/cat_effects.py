"""Catalogue: effects on rates, strata, subgroups, and tests on times."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.functions.effects import cohens_h
from armscope.functions.tails import normal_cdf, two_sided_p
from armscope.operators import distribution, means, proportions, ranks, sampling
from armscope.plans.registry import SPEC, events_rows, orders_units, prepost_units, query, rounded
from armscope.plans.sqltext import (
    EVENTS_ROWS,
    ORDERS_UNITS,
    PREPOST,
    cdf,
    div,
    hashed,
    mid_ranked,
    p_two,
    paired,
    r,
    rs,
    student_p,
    z_test,
)

_ORDERS_PAIR = f"WITH {ORDERS_UNITS}, cells AS ({paired('u', 'converted')})"
_ORDERS_STRATA = f"WITH {ORDERS_UNITS}, cells AS ({paired('u', 'converted', 'country')})"


@query(
    "st01_lift",
    f"""{_ORDERS_PAIR}
SELECT experiment, treatment, {rs('control_pct=mean_c * 100', 'treatment_pct=mean_t * 100',
 'lift_pp=(mean_t - mean_c) * 100', f"lift_rel_pct={div('mean_t - mean_c', 'mean_c')} * 100")} FROM cells""",
)
def st01(spark, sf_dir):
    return rounded(proportions.lift(orders_units(spark, sf_dir), SPEC))


_Z_COLUMNS = f"""n_c, cast(total_c as bigint) AS total_c, n_t, cast(total_t as bigint) AS total_t,
 {rs('p_c', 'p_t', 'p_pool', 'diff', 'se_pooled', 'se_diff', 'z', 'ci_low', 'ci_high', 'p_value')},
 verdict, direction, negligible, gain_negligible"""


@query(
    "st02_two_prop_z",
    f"{_ORDERS_PAIR}, {z_test('cells')} SELECT experiment, treatment, {_Z_COLUMNS} FROM zt",
)
def st02(spark, sf_dir):
    """ST2, ST3, ST4: pooled z, unpooled interval, verdict."""
    return rounded(proportions.two_proportion_z(orders_units(spark, sf_dir), SPEC))


@query(
    "st05_stratified_z",
    f"{_ORDERS_STRATA}, {z_test('cells')} SELECT experiment, country, treatment, {_Z_COLUMNS} FROM zt",
)
def st05(spark, sf_dir):
    return rounded(proportions.stratified_z(orders_units(spark, sf_dir), SPEC))


@query(
    "st06_simpson_check",
    f"""{_ORDERS_STRATA}, {z_test('cells')},
s AS (
  SELECT experiment, treatment, count(*) AS n_strata,
    count(*) FILTER (direction = 'treatment_higher') AS n_treatment_higher,
    count(*) FILTER (direction = 'control_higher') AS n_control_higher,
    CASE WHEN {div('sum(total_c)', 'sum(n_c)')} > {div('sum(total_t)', 'sum(n_t)')} THEN 'control_higher'
         ELSE 'treatment_higher' END AS overall_direction
  FROM zt GROUP BY experiment, treatment)
SELECT *, n_treatment_higher > 0 AND n_control_higher > 0 AS strata_disagree,
  n_treatment_higher > 0 AS any_treatment_higher,
  CASE WHEN overall_direction = 'treatment_higher' THEN n_control_higher > 0 ELSE n_treatment_higher > 0 END
    AS reverses_overall FROM s""",
)
def st06(spark, sf_dir):
    """ST6 and AG13."""
    return proportions.simpson_check(orders_units(spark, sf_dir), SPEC)


@query(
    "mb09_chi_square",
    f"""{_ORDERS_STRATA}, {z_test('cells')}
SELECT experiment, country, treatment, n_c, cast(total_c as bigint) AS total_c, n_t,
  cast(total_t as bigint) AS total_t, {rs('chi2=z * z', 'p_value')} FROM zt""",
)
def mb09(spark, sf_dir):
    """Checked against the square of the pooled z."""
    return rounded(proportions.chi_square_2x2(orders_units(spark, sf_dir), SPEC, by=["country"]))


@query(
    "mb14_stratum_adjusted",
    f"""{_ORDERS_STRATA},
s AS (SELECT *, n_c + n_t AS n FROM cells WHERE n_c > 0 AND n_t > 0),
t AS (
  SELECT experiment, treatment, count(*) AS n_strata,
    sum(total_t) / sum(n_t) - sum(total_c) / sum(n_c) AS crude_diff,
    sum((total_t * n_c - total_c * n_t) / n) / sum(n_t * n_c / n) AS mh_diff,
    sum(total_t * (n_c - total_c) / n) / sum(total_c * (n_t - total_t) / n) AS mh_odds_ratio,
    sum(n * (mean_t - mean_c)) / sum(n) AS poststrat_diff,
    sqrt(sum(n * n * (mean_t * (1 - mean_t) / n_t + mean_c * (1 - mean_c) / n_c))) / sum(n) AS poststrat_se
  FROM s GROUP BY experiment, treatment),
q AS (SELECT *, {div('poststrat_diff', 'poststrat_se')} AS z FROM t)
SELECT experiment, treatment, n_strata, {rs('crude_diff', 'mh_diff', 'mh_odds_ratio', 'poststrat_diff',
 'poststrat_se', 'z', f"p_value={p_two('z')}")} FROM q""",
)
def mb14(spark, sf_dir):
    return rounded(proportions.stratum_adjusted(orders_units(spark, sf_dir), SPEC))


_SF_Z = "value / 12 - 4"


@query(
    "sf05_sf06_sf07_functions",
    f"""WITH v AS (SELECT event_id, value, {_SF_Z} AS z FROM events)
SELECT event_id, {rs('root=sqrt(value)', 'size=abs(z)', 'odds=exp(z / 10)', f"law={cdf('z')}", f"p={p_two('z')}",
  'h=2 * asin(sqrt(least(value / 1000, 1))) - 2 * asin(sqrt(0.12))')} FROM v""",
)
def sf05(spark, sf_dir):
    """Scalar functions over every event value."""
    z = F.col("value") / 12 - 4
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", z.alias("z"))
    return rounded(
        events.select(
            "event_id",
            F.sqrt("value").alias("root"),
            F.abs("z").alias("size"),
            F.exp(F.col("z") / 10).alias("odds"),
            normal_cdf(F.col("z")).alias("law"),
            two_sided_p(F.col("z")).alias("p"),
            cohens_h(F.least(F.col("value") / 1000, F.lit(1.0)), F.lit(0.12)).alias("h"),
        )
    )


_SUBGROUPS = "CASE WHEN time_seconds < 1800 THEN 'quick' ELSE 'slow' END"


def _subgroups(gate: int) -> str:
    return f"""WITH {EVENTS_ROWS}, s AS (SELECT *, {_SUBGROUPS} AS speed FROM e),
cells AS ({paired('s', 'converted', 'country, speed')}),
g AS (
  SELECT *, sqrt(var_c / n_c + var_t / n_t) * 100 AS se_pp, (mean_t - mean_c) * 100 AS cate_pp
  FROM cells WHERE n_c >= {gate} AND n_t >= {gate})"""


@query(
    "st22_subgroup_effects",
    f"""{_subgroups(100)}
SELECT experiment, country, speed, treatment, n_c, n_t, {rs('control_pct=mean_c * 100', 'treatment_pct=mean_t * 100',
 'cate_pp', 'se_pp', 'ci_low_pp=cate_pp - 1.96 * se_pp', 'ci_high_pp=cate_pp + 1.96 * se_pp')},
 cast(row_number() OVER (PARTITION BY experiment, treatment ORDER BY cate_pp) as int) AS effect_rank FROM g""",
)
def st22(spark, sf_dir):
    """ST22, PF7, SL2: subgroup effects in ascending order."""
    rows = events_rows(spark, sf_dir).withColumn(
        "speed", F.when(F.col("time_seconds") < 1800, "quick").otherwise("slow")
    )
    return rounded(
        proportions.ranked_effects(proportions.subgroup_effects(rows, SPEC, ["country", "speed"]), SPEC)
    )


@query(
    "st23_two_sample_z",
    f"""WITH {PREPOST},
cells AS (SELECT experiment, country, count(*) FILTER (arm = 'control') AS n_c, count(*) FILTER (arm = 'treatment') AS n_t,
  avg(post) FILTER (arm = 'control') - avg(post) FILTER (arm = 'treatment') AS diff,
  sqrt({div("var_pop(post) FILTER (arm = 'control')", "count(*) FILTER (arm = 'control')")}
     + {div("var_pop(post) FILTER (arm = 'treatment')", "count(*) FILTER (arm = 'treatment')")}) AS se
  FROM pp GROUP BY experiment, country),
q AS (SELECT *, {div('diff', 'se')} AS z FROM cells), w AS (SELECT *, {p_two('z')} AS p_value FROM q)
SELECT experiment, country, 'treatment' AS treatment, n_c, n_t, {rs('diff', 'se', 'z', 'p_value')},
  CASE WHEN p_value < 0.05 THEN 'significant' WHEN p_value >= 0.05 THEN 'not_significant' END AS verdict FROM w""",
)
def st23(spark, sf_dir):
    return rounded(means.two_sample_z(prepost_units(spark, sf_dir), SPEC, "post", ["country"]))


_T_COLUMNS = f"n_c, n_t, {rs('mean_c', 'mean_t', 't', 'df')}, {r(student_p('t', 'df'))} AS p_value"


def _welch(source: str, metric: str, by: str = "", where: str = "true") -> str:
    return f"""cells AS ({paired(source, metric, by, where)}),
w0 AS (SELECT *, {div('var_c', 'n_c')} AS v1, {div('var_t', 'n_t')} AS v2 FROM cells),
w AS (SELECT *, {div('mean_c - mean_t', 'sqrt(v1 + v2)')} AS t,
  {div('(v1 + v2) * (v1 + v2)', f"{div('v1 * v1', 'n_c - 1')} + {div('v2 * v2', 'n_t - 1')}")} AS df FROM w0)"""


@query(
    "st11_welch_t",
    f"WITH {EVENTS_ROWS}, {_welch('e', 'time_seconds', 'country')} SELECT experiment, country, treatment, {_T_COLUMNS} FROM w",
)
def st11(spark, sf_dir):
    return rounded(means.welch_t(events_rows(spark, sf_dir), SPEC, by=["country"]))


@query(
    "st12_welch_t_converted",
    f"WITH {EVENTS_ROWS}, {_welch('e', 'time_seconds', '', 'converted = 1')} SELECT experiment, treatment, {_T_COLUMNS} FROM w",
)
def st12(spark, sf_dir):
    return rounded(means.welch_t(events_rows(spark, sf_dir), SPEC, where=F.col("converted") == 1))


@query(
    "mb10_pooled_t",
    f"""WITH {EVENTS_ROWS}, cells AS ({paired('e', 'value')}),
w AS (SELECT *, cast(n_c + n_t - 2 as double) AS df,
  (mean_c - mean_t) / sqrt(((n_c - 1) * var_c + (n_t - 1) * var_t) / (n_c + n_t - 2) * (1.0 / n_c + 1.0 / n_t)) AS t
  FROM cells)
SELECT experiment, treatment, n_c, n_t, {rs('t', 'df')}, {r(student_p('t', 'df'))} AS p_value FROM w""",
)
def mb10(spark, sf_dir):
    return rounded(means.pooled_t(events_rows(spark, sf_dir), SPEC, "value"))


_MW_COLUMNS = f"""n1, n2, {rs('rank_sum', 'u', 'sigma', 'z', 'p_value')},
  CASE WHEN p_value < 0.05 THEN 'significant' WHEN p_value >= 0.05 THEN 'not_significant' END AS verdict"""


@query(
    "st08_mann_whitney",
    f"WITH {EVENTS_ROWS}, {mid_ranked('e', 'value')} SELECT experiment, {_MW_COLUMNS} FROM mw",
)
def st08(spark, sf_dir):
    """On the tied ``value`` column, so that the tie correction matters."""
    return rounded(ranks.mann_whitney(events_rows(spark, sf_dir), SPEC, "value"))


@query(
    "st08_mann_whitney_time",
    f"WITH {EVENTS_ROWS}, {mid_ranked('e', 'time_seconds')} SELECT experiment, {_MW_COLUMNS} FROM mw",
)
def st08_time(spark, sf_dir):
    return rounded(ranks.mann_whitney(events_rows(spark, sf_dir), SPEC))


@query(
    "st09_mann_whitney_converted",
    f"WITH {EVENTS_ROWS}, ec AS (SELECT * FROM e WHERE converted = 1), {mid_ranked('ec', 'time_seconds')} SELECT experiment, {_MW_COLUMNS} FROM mw",
)
def st09(spark, sf_dir):
    return rounded(ranks.mann_whitney(events_rows(spark, sf_dir).filter("converted = 1"), SPEC))


@query(
    "st10_mann_whitney_country",
    f"WITH {EVENTS_ROWS}, {mid_ranked('e', 'time_seconds', 'country')} SELECT experiment, country, {_MW_COLUMNS} FROM mw",
)
def st10(spark, sf_dir):
    return rounded(ranks.mann_whitney(events_rows(spark, sf_dir), SPEC, by=["country"]))


@query(
    "wn02_mid_ranks",
    f"""WITH {EVENTS_ROWS}, c AS (SELECT experiment, country, value, count(*) AS n FROM e GROUP BY ALL)
SELECT experiment, country, {rs('value')}, n, {r("coalesce(sum(n) OVER (PARTITION BY experiment, country ORDER BY value "
 "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0")} AS mid_rank FROM c""",
)
def wn02(spark, sf_dir):
    return rounded(ranks.mid_ranks(events_rows(spark, sf_dir), ["experiment", "country"], "value"))


@query(
    "ml05_auc_of_score",
    f"""WITH {EVENTS_ROWS}, {mid_ranked('e', 'value', '', 'converted = 1')}
SELECT experiment, n1 AS n_positive, n2 AS n_negative, {r(div('u', 'cast(n1 as double) * n2'))} AS auc FROM mw""",
)
def ml05(spark, sf_dir):
    """Exact AUC of a numeric score, here the event value."""
    return rounded(ranks.auc(events_rows(spark, sf_dir), ["experiment"], "value", "converted"))


@query(
    "st07_normality",
    f"""WITH {EVENTS_ROWS},
m AS (SELECT experiment, arm, count(*) AS n, avg(time_seconds) AS mean, stddev_samp(time_seconds) AS sd
  FROM e GROUP BY experiment, arm),
c AS (SELECT experiment, arm, time_seconds AS v, count(*) AS c FROM e GROUP BY experiment, arm, time_seconds),
k AS (SELECT c.*, m.n, m.mean, m.sd, (v - mean) / sd AS s, sum(c) OVER (PARTITION BY c.experiment, c.arm ORDER BY v) AS upto
  FROM c JOIN m USING (experiment, arm)),
d AS (SELECT experiment, arm, n, mean, sd, max(greatest(abs(upto / n::double - {cdf('s')}),
  abs((upto - c) / n::double - {cdf('s')}))) AS ks FROM k GROUP BY ALL),
p AS (SELECT *, least(1.0, 2 * (SELECT sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * n * ks * ks))
  FROM range(1, 101) AS terms(j))) AS p_value FROM d)
SELECT experiment, arm, n, {rs('mean', 'sd', 'ks', 'p_value')}, p_value > 0.05 AS normal FROM p""",
)
def st07(spark, sf_dir):
    """Distance to the normal law over all rows of each arm (no sample needed)."""
    return rounded(ranks.normality(events_rows(spark, sf_dir), SPEC))


@query(
    "wn04_fixed_size_sample",
    f"""WITH {EVENTS_ROWS}
SELECT seq, arm FROM e QUALIFY row_number() OVER (PARTITION BY experiment, arm
  ORDER BY {hashed("'42' || chr(58) || seq")}, seq) <= 2000""",
)
def wn04(spark, sf_dir):
    rows = events_rows(spark, sf_dir).withColumn("arm", F.col("group"))
    return sampling.fixed_size_sample(rows, ["experiment", "arm"], ["seq"], 2000).select("seq", "arm")


@query(
    "st07_normality_of_sample",
    f"""WITH {EVENTS_ROWS},
q AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY experiment, arm
  ORDER BY {hashed("'42' || chr(58) || seq")}, seq) <= 5000),
m AS (SELECT experiment, arm, count(*) AS n, avg(time_seconds) AS mean, stddev_samp(time_seconds) AS sd
  FROM q GROUP BY experiment, arm),
k AS (SELECT q.experiment, q.arm, m.n, m.mean, m.sd, (time_seconds - mean) / sd AS s,
  rank() OVER (PARTITION BY q.experiment, q.arm ORDER BY time_seconds) - 1 AS below,
  count(*) OVER (PARTITION BY q.experiment, q.arm ORDER BY time_seconds) AS upto FROM q JOIN m USING (experiment, arm)),
d AS (SELECT experiment, arm, n, mean, sd, max(greatest(abs(upto / n::double - {cdf('s')}),
  abs(below / n::double - {cdf('s')}))) AS ks FROM k GROUP BY ALL),
p AS (SELECT *, least(1.0, 2 * (SELECT sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * n * ks * ks))
  FROM range(1, 101) AS terms(j))) AS p_value FROM d)
SELECT experiment, arm, n, {rs('mean', 'sd', 'ks', 'p_value')}, p_value > 0.05 AS normal FROM p""",
)
def st07_sample(spark, sf_dir):
    """The same on a seeded sample of up to 5000 rows per arm, the sampling operator's own size."""
    rows = events_rows(spark, sf_dir)
    sample = sampling.fixed_size_sample(rows, ["experiment", "group"], ["seq"], 5000)
    return rounded(ranks.normality(sample, SPEC))


@query(
    "wn03_stratified_folds",
    f"""WITH {EVENTS_ROWS}
SELECT seq, converted, cast((row_number() OVER (PARTITION BY experiment, converted
  ORDER BY {hashed("'fold42' || chr(58) || seq")}, seq) - 1) % 5 as int) AS fold FROM e""",
)
def wn03(spark, sf_dir):
    return sampling.stratified_folds(
        events_rows(spark, sf_dir), ["experiment"], "converted", ["seq"]
    ).select("seq", "converted", "fold")


@query(
    "wn03_hash_folds",
    f"""WITH {EVENTS_ROWS} SELECT seq, cast({hashed("'fold42' || chr(58) || seq")} % 5 as int) AS fold FROM e""",
)
def wn03_hash(spark, sf_dir):
    return sampling.hash_folds(events_rows(spark, sf_dir), ["seq"]).select("seq", "fold")


def _location(by: str) -> str:
    return f"""WITH {EVENTS_ROWS}, l AS (SELECT experiment{by}, arm, count(*) AS n, avg(time_seconds) AS mean_s,
  stddev_samp(time_seconds) AS sd_s, quantile_cont(time_seconds, 0.5) AS median_s FROM e GROUP BY ALL)
SELECT experiment{by}, arm, n, {rs('mean_s', 'sd_s', 'median_s')}, {r('mean_s / 60', 7)} AS mean_min,
 {r('median_s / 60', 7)} AS median_min, {r(f"mean_s - max(mean_s) FILTER (arm = 'control') OVER (PARTITION BY experiment{by})")}
 AS diff_to_control_s FROM l"""


def _round_location(df):
    # Microseconds over 60 tie at the sixth digit, so the minutes keep a seventh.
    minutes = {c: F.round(c, 7) for c in ("mean_min", "median_min")}
    seconds = {c: F.round(c, 6) for c in ("mean_s", "sd_s", "median_s", "diff_to_control_s")}
    return df.withColumns({**minutes, **seconds})


@query("st13_location_summary", _location(""))
def st13(spark, sf_dir):
    return _round_location(means.location_summary(events_rows(spark, sf_dir), SPEC))


@query("mb27_decision_and_browse_time", _location(", converted"))
def mb27(spark, sf_dir):
    """Time of converted users (decision) and of the others (browsing), by arm."""
    return _round_location(means.location_summary(events_rows(spark, sf_dir), SPEC, by=["converted"]))


@query(
    "st14_bucket_rates",
    f"""WITH {EVENTS_ROWS}, b AS (SELECT *, cast(floor(time_seconds / 600) * 10 as int) AS bucket_low FROM e),
cells AS ({paired('b', 'converted', 'bucket_low')})
SELECT experiment, treatment, bucket_low, bucket_low || '-' || (bucket_low + 10) AS bucket, n_c, n_t,
 {rs('control_pct=mean_c * 100', 'treatment_pct=mean_t * 100', 'diff_pp=(mean_t - mean_c) * 100')} FROM cells
WHERE bucket_low < 60""",
)
def st14(spark, sf_dir):
    return rounded(distribution.bucket_rates(events_rows(spark, sf_dir), SPEC))


@query(
    "st14_with_overflow",
    f"""WITH {EVENTS_ROWS}, b AS (SELECT *, least(cast(floor(time_seconds / 300) * 5 as int), 30) AS bucket_low FROM e),
cells AS ({paired('b', 'converted', 'bucket_low')})
SELECT experiment, treatment, bucket_low, CASE WHEN bucket_low = 30 THEN '30+' ELSE bucket_low || '-' || (bucket_low + 5) END AS bucket,
 n_c, n_t, {rs('control_pct=mean_c * 100', 'treatment_pct=mean_t * 100', 'diff_pp=(mean_t - mean_c) * 100')} FROM cells""",
)
def st14_overflow(spark, sf_dir):
    """Five-minute buckets up to half an hour; what comes later has a bucket of its own."""
    return rounded(distribution.bucket_rates(events_rows(spark, sf_dir), SPEC, width=5, last=30, overflow=True))


@query(
    "ag14_histogram",
    f"""WITH {EVENTS_ROWS}, m AS (SELECT min(time_seconds / 60) AS lo, max(time_seconds / 60) AS hi FROM e),
b AS (SELECT experiment, arm, least(cast(floor((time_seconds / 60 - lo) / ((hi - lo) / 60)) as int), 59) AS bin, lo,
  (hi - lo) / 60 AS w FROM e, m),
c AS (SELECT experiment, arm, bin, lo, w, count(*) AS n FROM b GROUP BY ALL)
SELECT experiment, arm, bin, {rs('bin_low=lo + bin * w', 'bin_high=lo + (bin + 1) * w',
 'density=n / (sum(n) OVER (PARTITION BY experiment, arm) * w)')}, n FROM c""",
)
def ag14(spark, sf_dir):
    """AG14 and the first half of CD4."""
    rows = events_rows(spark, sf_dir).withColumn("time_min", F.col("time_seconds") / 60)
    return rounded(distribution.histogram(rows, SPEC, "time_min"))

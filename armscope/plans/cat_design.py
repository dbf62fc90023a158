"""Catalogue: assignment, audits, clusters, interleaving, effects over time."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from armscope.functions.hashing import hash_arm, hash_number
from armscope.operators import design, prepare, timeline
from armscope.plans.registry import SPEC, events_log, orders_log, orders_units, query, rounded
from armscope.plans.sqltext import (
    COUNTRIES,
    EVENTS_LOG,
    ORDERS_LOG,
    ORDERS_UNITS,
    WRONG,
    arm,
    div,
    hashed,
    p_two,
    paired,
    r,
    rs,
    student_p,
    z_test,
)
from armscope.sources import views


@query(
    "mb01_hash_assignment",
    f"""SELECT c_custkey, {hashed("'exp1' || chr(58) || c_custkey")} AS slot, {arm('c_custkey')} AS arm FROM customer""",
)
def mb01(spark, sf_dir):
    unit = F.col("c_custkey")
    return views.table(spark, sf_dir, "customer").select(
        "c_custkey", hash_number("exp1", unit).alias("slot"), hash_arm("exp1", unit).alias("arm")
    )


LAYERS = ("layer_page", "layer_price", "layer_rank")
_LAYER_ARMS = ", ".join(f"{arm('c_custkey', repr(s))} AS {s}" for s in LAYERS)
_LAYER_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS layer_a, '{b}' AS layer_b, {a} AS arm_a, {b} AS arm_b FROM t"
    for i, a in enumerate(LAYERS)
    for b in LAYERS[i + 1 :]
)


@query(
    "mb02_layer_independence",
    f"""WITH t AS (SELECT {_LAYER_ARMS} FROM customer), p AS ({_LAYER_PAIRS}),
c AS (SELECT layer_a, layer_b, count(*) AS n,
  count(*) FILTER (arm_a = 'control' AND arm_b = 'control') AS a, count(*) FILTER (arm_a = 'control' AND arm_b <> 'control') AS b,
  count(*) FILTER (arm_a <> 'control' AND arm_b = 'control') AS c, count(*) FILTER (arm_a <> 'control' AND arm_b <> 'control') AS d
  FROM p GROUP BY ALL),
x AS (SELECT *, n * (a * d - b * c)::double * (a * d - b * c) / ((a + b)::double * (c + d) * (a + c) * (b + d)) AS chi2 FROM c),
y AS (SELECT *, sqrt(chi2) AS z FROM x)
SELECT layer_a, layer_b, n, 2::bigint AS n_rows, 2::bigint AS n_columns, {rs('chi2')}, 1::bigint AS df, {rs(f"p_value={p_two('z')}")} FROM y""",
)
def mb02(spark, sf_dir):
    return rounded(design.layer_independence(views.table(spark, sf_dir, "customer"), "c_custkey", LAYERS))


SPLITS = {
    "50_50": [("control", 50), ("treatment", 50)],
    "70_30": [("control", 70), ("treatment", 30)],
    "90_10": [("control", 90), ("treatment", 10)],
}
_SLOT = hashed("'ramp' || chr(58) || c_custkey") + " % 10000"
_SPLIT_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS split, CASE WHEN slot < {shares[0][1] * 100} THEN 'control' ELSE 'treatment' END AS arm FROM s"
    for name, shares in SPLITS.items()
)


@query(
    "mb03_traffic_splits",
    f"""WITH s AS (SELECT {_SLOT} AS slot FROM customer), a AS ({_SPLIT_ROWS}),
c AS (SELECT split, arm, count(*) AS n FROM a GROUP BY ALL)
SELECT split, arm, n, {rs('share=n / sum(n) OVER (PARTITION BY split)')} FROM c""",
)
def mb03(spark, sf_dir):
    return rounded(
        design.split_counts(views.table(spark, sf_dir, "customer"), "c_custkey", "ramp", SPLITS)
    )


AA_SALTS = tuple(f"aa{i}" for i in range(20))
_AA_SQL = f"""WITH {ORDERS_UNITS},
a AS (SELECT experiment, user_id, converted, 'aa' || i AS salt FROM u, range(0, {len(AA_SALTS)}) AS salts(i)),
b AS (SELECT *, {arm('user_id', 'salt')} AS arm FROM a),
cells AS ({paired('b', 'converted', 'salt')}), {z_test('cells')}"""


@query(
    "mb07_aa_replicates",
    f"""{_AA_SQL} SELECT experiment, salt, n_c, n_t, {rs('diff', 'z', 'p_value')} FROM zt""",
)
def mb07(spark, sf_dir):
    tests = design.aa_replicates(orders_units(spark, sf_dir), SPEC, AA_SALTS)
    return rounded(tests.select("experiment", "salt", "n_c", "n_t", "diff", "z", "p_value"))


@query(
    "mb07_aa_summary",
    f"""{_AA_SQL} SELECT experiment, count(p_value) AS n_replicates, count(*) FILTER (p_value < 0.05) AS n_significant,
 {rs('false_positive_rate=avg((p_value < 0.05)::double)', 'min_p=min(p_value)', 'max_p=max(p_value)')} FROM zt GROUP BY experiment""",
)
def mb07_summary(spark, sf_dir):
    return rounded(
        design.aa_summary(design.aa_replicates(orders_units(spark, sf_dir), SPEC, AA_SALTS), SPEC)
    )


def _ratio_sql(by: str = "") -> str:
    item = f", {by}" if by else ""
    return f"""c AS (SELECT experiment{item}, count(*) FILTER (arm = 'control') AS n_control,
  count(*) FILTER (arm = 'treatment') AS n_treatment FROM u GROUP BY ALL),
x AS (SELECT *, (n_control - n_treatment) ** 2 / (n_control + n_treatment)::double AS chi2 FROM c),
y AS (SELECT *, sqrt(chi2) AS z FROM x), q AS (SELECT *, {p_two('z')} AS p_value FROM y)
SELECT experiment{item}, n_control, n_treatment, {rs('chi2', 'p_value')}, p_value < 0.001 AS mismatch_alarm FROM q"""


@query("mb08_sample_ratio", f"WITH {ORDERS_UNITS}, {_ratio_sql()}")
def mb08(spark, sf_dir):
    return rounded(design.sample_ratio(orders_units(spark, sf_dir), SPEC))


@query(
    "mb08_planned_split",
    f"""WITH {EVENTS_LOG}, n AS (SELECT experiment, count(DISTINCT user_id) FILTER ({hashed("'split:' || user_id")} % 10 < 7) AS n_control,
  count(DISTINCT user_id) FILTER ({hashed("'split:' || user_id")} % 10 >= 7) AS n_treatment FROM log GROUP BY experiment),
q AS (SELECT *, n_control + n_treatment AS n FROM n),
x AS (SELECT *, sqrt(power(n_control - 0.7 * n, 2) / (0.7 * n) + power(n_treatment - 0.3 * n, 2) / (0.3 * n)) AS root FROM q)
SELECT experiment, n_control, n_treatment, {rs('chi2=root * root')}, {r(p_two('root'))} AS p_value, {p_two('root')} < 0.001 AS mismatch_alarm FROM x""",
)
def mb08_planned(spark, sf_dir):
    """A 70:30 split, checked against the shares in the spec."""
    users = events_log(spark, sf_dir).select("experiment", "user_id").distinct()
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), F.col("user_id").cast("string"))), 1, 8), 16, 10).cast("bigint")
    users = users.withColumn("group", F.when(bucket % 10 < 7, "control").otherwise("treatment"))
    return rounded(design.sample_ratio(users, replace(SPEC, shares=(0.7, 0.3))))


@query("mb08_sample_ratio_by_stratum", f"WITH {ORDERS_UNITS}, {_ratio_sql('country')}")
def mb08_strata(spark, sf_dir):
    return rounded(design.sample_ratio(orders_units(spark, sf_dir), SPEC, by=["country"]))


@query(
    "mb08_stratum_balance",
    f"""WITH {ORDERS_UNITS},
c AS (SELECT experiment, country, arm, count(*) AS n FROM u GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY country) * sum(n) OVER (PARTITION BY arm) / sum(n) OVER ()::double AS e FROM c),
x AS (SELECT experiment, cast(sum(n) as bigint) AS n, count(DISTINCT country) AS n_rows, count(DISTINCT arm) AS n_columns,
  sum((n - e) ** 2 / e) AS chi2 FROM e GROUP BY experiment)
SELECT experiment, n, n_rows, n_columns, (n_rows - 1) * (n_columns - 1) AS df, {rs('chi2', 'p_value=exp(-chi2 / 2) * (1 + chi2 / 2)')} FROM x""",
)
def mb08_balance(spark, sf_dir):
    """Five regions by two arms: four degrees of freedom, whose tail has a short closed form."""
    return rounded(design.stratum_balance(orders_units(spark, sf_dir), SPEC))


@query(
    "mb08_standardised_differences",
    f"""WITH {ORDERS_UNITS},
m AS (SELECT experiment, avg(amount) FILTER (arm = 'control') AS ac, avg(amount) FILTER (arm = 'treatment') AS mt,
  var_samp(amount) FILTER (arm = 'control') AS avc, var_samp(amount) FILTER (arm = 'treatment') AS avt,
  avg(seq) FILTER (arm = 'control') AS sc, avg(seq) FILTER (arm = 'treatment') AS st,
  var_samp(seq) FILTER (arm = 'control') AS svc, var_samp(seq) FILTER (arm = 'treatment') AS svt FROM u GROUP BY experiment)
SELECT experiment, 'amount' AS covariate, {rs('mean_c=ac', 'mean_t=mt', 'smd=(mt - ac) / sqrt((avc + avt) / 2)')} FROM m
UNION ALL SELECT experiment, 'seq', {rs('mean_c=sc', 'mean_t=st', 'smd=(st - sc) / sqrt((svc + svt) / 2)')} FROM m""",
)
def mb08_smd(spark, sf_dir):
    return rounded(design.standardised_differences(orders_units(spark, sf_dir), SPEC, ["amount", "seq"]))


@query(
    "mb13_cluster_effect",
    f"""WITH {ORDERS_UNITS},
o AS (SELECT experiment, c_nationkey AS cluster, avg(converted) AS cm FROM u JOIN customer ON user_id = c_custkey GROUP BY ALL),
cl AS (SELECT *, {arm('cluster', "'clusters'")} AS arm FROM o),
cells AS ({paired('cl', 'cm')}),
w0 AS (SELECT *, var_c / n_c AS v1, var_t / n_t AS v2 FROM cells),
w AS (SELECT *, (mean_c - mean_t) / sqrt(v1 + v2) AS t, (v1 + v2) ** 2 / (v1 * v1 / (n_c - 1) + v2 * v2 / (n_t - 1)) AS df FROM w0)
SELECT experiment, treatment, n_c, n_t, {rs('mean_c', 'mean_t', 't', 'df')}, {r(student_p('t', 'df'))} AS p_value FROM w""",
)
def mb13(spark, sf_dir):
    return rounded(
        design.cluster_effect(orders_units(spark, sf_dir), views.user_nations(spark, sf_dir), SPEC, "clusters")
    )


@query(
    "mb13_spillover_boundary",
    f"""WITH {ORDERS_UNITS},
ed AS (SELECT c_custkey AS a, c_custkey + s AS b FROM customer, (VALUES (1), (7)) AS steps(s)),
pairs AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed),
n AS (SELECT me.experiment, me.user_id, max((you.arm <> me.arm)::int) AS other
  FROM pairs JOIN u me ON a = me.user_id JOIN u you ON b = you.user_id GROUP BY ALL),
p AS (SELECT u.*, CASE WHEN other = 1 THEN 'boundary' ELSE 'core' END AS position FROM u LEFT JOIN n USING (experiment, user_id)),
g AS (SELECT experiment, arm, position, count(converted) AS n, avg(converted) AS mean FROM p GROUP BY ALL)
SELECT experiment, arm, position, n, {rs('mean', 'share=n / sum(n) OVER (PARTITION BY experiment, arm)')} FROM g""",
)
def mb13_boundary(spark, sf_dir):
    return rounded(
        design.spillover_boundary(orders_units(spark, sf_dir), views.user_edges(spark, sf_dir), SPEC)
    )


@query(
    "mb24_interleaving",
    f"""WITH {EVENTS_LOG},
p AS (SELECT experiment, user_id, count(*) FILTER (k % 2 = 0) AS a, count(*) FILTER (k % 2 = 1) AS b
  FROM log WHERE event_type = 'click' GROUP BY ALL),
m AS (SELECT experiment, count(*) AS n_units, cast(sum(a) as bigint) AS clicks_first, cast(sum(b) as bigint) AS clicks_second,
  avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd_diff, count(*) FILTER (a > b) AS wins_first, count(*) FILTER (a < b) AS wins_second
  FROM p GROUP BY experiment),
q AS (SELECT *, {div('mean_diff * sqrt(n_units)', 'sd_diff')} AS z, {div('wins_first - wins_second', 'sqrt(wins_first + wins_second)')} AS sign_z FROM m)
SELECT experiment, n_units, clicks_first, clicks_second, {rs('mean_diff', 'sd_diff')}, wins_first, wins_second,
 {rs('z', 'sign_z', f"p_value={p_two('z')}", f"sign_p_value={p_two('sign_z')}")} FROM q""",
)
def mb24(spark, sf_dir):
    return rounded(design.interleaving(views.list_clicks(spark, sf_dir), SPEC, "list", "A", "B"))


_DAY_CELLS = """SELECT experiment, {day}, count(*) FILTER (arm = 'control') AS n_c, count(*) FILTER (arm = 'treatment') AS n_t,
  coalesce(sum(converted) FILTER (arm = 'control'), 0) AS total_c, coalesce(sum(converted) FILTER (arm = 'treatment'), 0) AS total_t"""


@query(
    "mb05_lift_by_exposure_day",
    f"""WITH {EVENTS_LOG}, c AS (SELECT * FROM log WHERE NOT {WRONG}),
d AS (SELECT *, date_diff('day', cast(min(ts) OVER (PARTITION BY user_id) as date), cast(ts as date)) AS exposure_day FROM c),
cells AS ({_DAY_CELLS.format(day='exposure_day')} FROM d GROUP BY ALL), {z_test('cells')}
SELECT experiment, cast(exposure_day as int) AS exposure_day, n_c, n_t, {rs('p_c', 'p_t', 'lift_pp=(p_t - p_c) * 100', 'z', 'p_value')} FROM zt""",
)
def mb05(spark, sf_dir):
    log = prepare.drop_mismatched(events_log(spark, sf_dir), SPEC)
    return rounded(timeline.lift_by_exposure_day(log, SPEC))


@query(
    "mb17_peeking_guard",
    f"""WITH {EVENTS_LOG}, c AS (SELECT * FROM log WHERE NOT {WRONG}),
d AS ({_DAY_CELLS.format(day='cast(ts as date) AS day')} FROM c GROUP BY experiment, cast(ts as date)),
cells AS (SELECT experiment, day, sum(n_c) OVER w AS n_c, sum(n_t) OVER w AS n_t, sum(total_c) OVER w AS total_c, sum(total_t) OVER w AS total_t
  FROM d WINDOW w AS (PARTITION BY experiment ORDER BY day)), {z_test('cells')},
g AS (SELECT *, coalesce(p_value < 0.05, false) AS significant_today, least(n_c, n_t) >= 3000 AS planned_reached FROM zt),
f AS (SELECT *, row_number() OVER (PARTITION BY experiment, planned_reached ORDER BY day) AS k FROM g)
SELECT experiment, day, cast(n_c as bigint) AS n_c, cast(n_t as bigint) AS n_t, {rs('z', 'p_value')}, significant_today, planned_reached,
 bool_or(significant_today) OVER (PARTITION BY experiment ORDER BY day) AS peeker_stopped,
 CASE WHEN planned_reached AND k = 1 THEN CASE WHEN significant_today THEN 'significant' ELSE 'not_significant' END END AS fixed_horizon_verdict FROM f""",
)
def mb17(spark, sf_dir):
    log = prepare.drop_mismatched(events_log(spark, sf_dir), SPEC)
    return rounded(timeline.peeking_guard(log, SPEC, planned_n=3000))


@query(
    "j02_units_without_dimension",
    f"""WITH {ORDERS_LOG}, {COUNTRIES}, f AS (SELECT user_id, min(seq) AS seq FROM log WHERE NOT {WRONG} GROUP BY user_id)
SELECT user_id FROM f WHERE user_id NOT IN (SELECT user_id FROM dim WHERE country <> 'ASIA')""",
)
def j02(spark, sf_dir):
    """Units an inner join would lose, here against a dimension that lacks one region."""
    units = prepare.first_exposure(prepare.drop_mismatched(orders_log(spark, sf_dir), SPEC), SPEC)
    dimension = views.user_countries(spark, sf_dir).filter("country <> 'ASIA'")
    return prepare.units_without_dimension(units, dimension, SPEC).select("user_id")

"""Catalogue: practical significance, guardrails, subgroups, decision, chart tables, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from armscope.operators import decide, multiple, proportions
from armscope.operators.multiple import Metric
from armscope.plans.cat_effects import _subgroups
from armscope.plans.cat_power import METRICS, metric_sql
from armscope.plans.registry import SPEC, events_rows, orders_log, orders_units, prepost_units, query, rounded
from armscope.plans.sqltext import ORDERS_LOG, ORDERS_UNITS, PREPOST, WRONG, div, mid_ranked, p_two, paired, r, rs, z_test
from armscope.plans.statistical import record_for, statistical_analysis
from armscope.session import materialise, new_folder
from armscope.sources import views
from armscope.sources.tables import write_tables

_PRACTICAL = """CASE WHEN -ci_low < 0 THEN 'harmful' WHEN -ci_low < {m} THEN 'negligible' WHEN -ci_high >= {m} THEN 'useful'
  WHEN -ci_high > 0 THEN 'positive_size_open' WHEN -ci_high <= 0 THEN 'inconclusive' END"""


@query(
    "mb20_practical_significance",
    f"""WITH {ORDERS_UNITS}, cells AS ({paired('u', 'converted', 'country')}), {z_test('cells')},
q AS (SELECT *, {_PRACTICAL.format(m=0.05)} AS practical FROM zt)
SELECT experiment, country, treatment, {rs('effect=-diff', 'effect_low=-ci_high', 'effect_high=-ci_low', 'min_effect=0.05')}, practical,
 CASE WHEN practical IN ('harmful', 'negligible') THEN 'stop' WHEN practical = 'useful' THEN 'launch'
      WHEN practical IS NOT NULL THEN 'continue' END AS practical_action FROM q""",
)
def mb20(spark, sf_dir):
    tests = proportions.stratified_z(orders_units(spark, sf_dir), SPEC)
    return rounded(
        decide.practical_significance(tests, SPEC, 0.05).select(
            "experiment", "country", "treatment", "effect", "effect_low", "effect_high", "min_effect",
            "practical", "practical_action",
        )
    )


_MOVED = """CASE WHEN (ci_low > 0 AND good > 0) OR (ci_high < 0 AND good < 0) THEN 'better'
  WHEN (ci_low > 0 AND good < 0) OR (ci_high < 0 AND good > 0) THEN 'worse' WHEN ci_low IS NOT NULL THEN 'unclear' END"""


@query(
    "mb19_metric_movement",
    f"""WITH {PREPOST}, {metric_sql('country')}
SELECT experiment, country, metric, role, n_c, n_t, {rs('effect', 'se', 'p_value', 'ci_low', 'ci_high')}, {_MOVED} AS movement FROM mt""",
)
def mb19_movement(spark, sf_dir):
    tests = multiple.metric_tests(prepost_units(spark, sf_dir), SPEC, METRICS, by=["country"])
    return rounded(decide.metric_movement(tests).drop("good", "treatment"))


@query(
    "mb19_guardrails",
    f"""WITH {PREPOST}, {metric_sql()}, g AS (SELECT *, {_MOVED} AS movement FROM mt WHERE role = 'guardrail')
SELECT experiment, 'treatment' AS treatment, count(*) AS n_guardrails, count(*) FILTER (movement = 'worse') AS n_worse,
 coalesce(bool_or(movement = 'worse'), false) AS blocks_launch FROM g GROUP BY experiment""",
)
def mb19(spark, sf_dir):
    return decide.guardrail_status(multiple.metric_tests(prepost_units(spark, sf_dir), SPEC, METRICS), SPEC)


_CI = "SELECT *, cate_pp - 1.96 * se_pp AS lo, cate_pp + 1.96 * se_pp AS hi FROM g"


@query(
    "mb22_targeting_list",
    f"""{_subgroups(100)}, c AS ({_CI})
SELECT experiment, country, speed, treatment, {rs('cate_pp', 'ci_low_pp=lo', 'ci_high_pp=hi')}, hi < 0 AS harmed, lo > 0 AS helped,
 CASE WHEN lo > 0 THEN 'launch' WHEN hi < 0 THEN 'hold' ELSE 'undecided' END AS action FROM c""",
)
def mb22(spark, sf_dir):
    return rounded(
        decide.subgroup_actions(_speed_effects(spark, sf_dir)).select(
            "experiment", "country", "speed", "treatment", "cate_pp", "ci_low_pp", "ci_high_pp",
            "harmed", "helped", "action",
        )
    )


def _speed_effects(spark, sf_dir):
    rows = events_rows(spark, sf_dir).withColumn(
        "speed", F.when(F.col("time_seconds") < 1800, "quick").otherwise("slow")
    )
    return proportions.subgroup_effects(rows, SPEC, ["country", "speed"])


@query(
    "mb21_subgroup_consistency",
    f"""{_subgroups(100)}, c AS ({_CI})
SELECT experiment, treatment, count(*) AS n_subgroups, count(*) FILTER (hi < 0) AS n_harmed, count(*) FILTER (lo > 0) AS n_helped,
 bool_or(hi < 0) AS any_harmed, min(sign(cate_pp)) = max(sign(cate_pp)) AS same_sign FROM c GROUP BY experiment, treatment""",
)
def mb21(spark, sf_dir):
    return decide.subgroup_consistency(_speed_effects(spark, sf_dir), SPEC)


GUARDRAILS = [Metric("amount", "amount", "guardrail", 1)]
MIN_EFFECT = 0.01
_ZZ = SPEC.z_alpha + SPEC.z_power
_RECORD_SQL = f"""WITH {ORDERS_UNITS},
cells AS ({paired('u', 'converted')}), {z_test('cells')},
core AS (SELECT experiment, treatment, n_c, n_t, -diff AS effect, -ci_high AS effect_low, -ci_low AS effect_high, p_value, p_c,
  {_PRACTICAL.format(m=MIN_EFFECT)} AS practical FROM zt),
st AS ({paired('u', 'converted', 'country')}),
si AS (SELECT experiment, bool_or(mean_c > mean_t) AS anyc, bool_or(mean_c <= mean_t) AS anyt,
  sum(total_c) / sum(n_c) > sum(total_t) / sum(n_t) AS oc FROM st GROUP BY experiment),
sg AS (SELECT experiment, count(*) AS n_subgroups, count(*) FILTER (d + 1.96 * s < 0) AS n_harmed, count(*) FILTER (d - 1.96 * s > 0) AS n_helped
  FROM (SELECT experiment, mean_t - mean_c AS d, sqrt(var_c / n_c + var_t / n_t) AS s FROM st WHERE n_c >= 100 AND n_t >= 100) GROUP BY experiment),
gr AS (SELECT experiment, 1::bigint AS n_guardrails, (mean_t - mean_c + 1.96 * sqrt(var_c / n_c + var_t / n_t) < 0)::bigint AS n_worse
  FROM ({paired('u', 'amount')})),
qa AS (SELECT experiment, {div(f'count(*) FILTER {WRONG}', 'count(*)')} AS mismatch_rate FROM log GROUP BY experiment),
sr0 AS (SELECT experiment, sqrt((n_c - n_t) ** 2 / (n_c + n_t)::double) AS z FROM core),
sr AS (SELECT experiment, {p_two('z')} < 0.001 AS ratio_alarm FROM sr0),
sc AS (SELECT *, 'all' AS scope FROM u UNION ALL SELECT *, 'converted' FROM u WHERE converted = 1),
{mid_ranked('sc', 'amount', 'scope')},
au AS (SELECT experiment, max(p_value) FILTER (scope = 'all') AS aux_p_all, max(p_value) FILTER (scope = 'converted') AS aux_p_converted FROM mw GROUP BY experiment),
j AS (
  SELECT core.*, anyc AND anyt AS strata_disagree, CASE WHEN oc THEN anyt ELSE anyc END AS reverses_overall,
    {2 * _ZZ**2!r} / (2 * asin(sqrt(p_c)) - 2 * asin(sqrt(p_c * 1.01))) ** 2 AS n_required,
    n_guardrails, n_worse, coalesce(n_subgroups, 0) AS n_subgroups, coalesce(n_harmed, 0) AS n_harmed,
    coalesce(n_helped, 0) AS n_helped, mismatch_rate, ratio_alarm, true AS has_date, aux_p_all, aux_p_converted
  FROM core JOIN si USING (experiment) LEFT JOIN sg USING (experiment) JOIN gr USING (experiment) JOIN qa USING (experiment)
    JOIN sr USING (experiment) JOIN au USING (experiment)),
f AS (SELECT *, n_required / least(n_c, n_t) AS shortfall, p_value < 0.05 AS significant,
  least(aux_p_all, aux_p_converted) < 0.05 AS auxiliary_moved, NOT ratio_alarm AS quality_ok FROM j),
d AS (SELECT *, shortfall > 1 AS underpowered, CASE WHEN NOT quality_ok THEN 'redesign' WHEN n_worse > 0 THEN 'do_not_launch'
  WHEN significant AND effect < 0 THEN 'do_not_launch' WHEN significant AND practical = 'negligible' THEN 'do_not_launch'
  WHEN significant AND (reverses_overall OR n_harmed > 0) THEN 'launch_by_segment' WHEN significant THEN 'launch'
  WHEN practical IN ('negligible', 'harmful') THEN 'do_not_launch' WHEN shortfall > 1 THEN 'redesign' ELSE 'continue' END AS decision FROM f),
rec AS (SELECT *, CASE WHEN NOT quality_ok THEN 'repair_assignment_and_rerun' WHEN n_worse > 0 THEN 'fix_guardrails'
  WHEN decision = 'launch_by_segment' THEN 'launch_helped_segments_only' WHEN decision = 'launch' THEN 'monitor_after_launch'
  WHEN decision = 'redesign' THEN 'plan_sample_for_effect' WHEN decision = 'continue' THEN 'extend_until_interval_closes' WHEN reverses_overall THEN 'test_reversed_stratum_separately'
  ELSE 'stop_experiment' END AS next_step,
  concat_ws(',', CASE WHEN mismatch_rate > 0 THEN 'rows_mismatched' END, CASE WHEN ratio_alarm THEN 'arm_sizes_off_plan' END,
    CASE WHEN NOT has_date THEN 'no_date' END, CASE WHEN strata_disagree THEN 'confounding_by_stratum' END,
    CASE WHEN n_subgroups = 0 THEN 'no_subgroup_large_enough' END, CASE WHEN underpowered THEN 'underpowered' END) AS risks FROM d)"""


def _record(spark, sf_dir):
    # Eight results come from the units: write them out once.
    units = materialise(orders_units(spark, sf_dir))
    return record_for(
        orders_log(spark, sf_dir), units, SPEC, MIN_EFFECT, "amount", GUARDRAILS
    )


@query(
    "mb25_decision_record",
    f"""{_RECORD_SQL} SELECT experiment, treatment, decision, next_step, n_c, n_t, {rs('effect', 'effect_low', 'effect_high', 'p_value')},
 practical, strata_disagree, reverses_overall, {r('n_required', 3)} AS n_required, {r('shortfall', 4)} AS shortfall, n_guardrails, n_worse,
 n_subgroups, n_harmed, n_helped, {rs('mismatch_rate', 'aux_p_all', 'aux_p_converted')}, ratio_alarm, has_date, significant, underpowered,
 auxiliary_moved, quality_ok, risks FROM rec""",
)
def mb25(spark, sf_dir):
    record = _record(spark, sf_dir)
    record = record.withColumns({"n_required": F.round("n_required", 3), "shortfall": F.round("shortfall", 4)})
    return rounded(record.withColumn("risks", F.concat_ws(",", "risks")))


@query(
    "st21_decision_matrix",
    f"""{_RECORD_SQL}
SELECT experiment, treatment, decision, 'significance' AS dimension, CASE WHEN significant THEN 'significant' ELSE 'not_significant' END AS finding,
  CASE WHEN significant AND effect > 0 THEN 'launch' WHEN significant THEN 'do_not_launch' ELSE 'no_evidence' END AS points_to FROM rec
UNION ALL SELECT experiment, treatment, decision, 'effect_size', practical, CASE WHEN practical IN ('negligible', 'harmful') THEN 'do_not_launch'
  WHEN practical = 'useful' THEN 'launch' ELSE 'open' END FROM rec
UNION ALL SELECT experiment, treatment, decision, 'auxiliary_metric', CASE WHEN auxiliary_moved THEN 'moved' ELSE 'not_moved' END,
  CASE WHEN auxiliary_moved THEN 'review' ELSE 'no_gain' END FROM rec
UNION ALL SELECT experiment, treatment, decision, 'simpson', CASE WHEN reverses_overall THEN 'reversed_stratum' WHEN strata_disagree THEN 'strata_disagree'
  ELSE 'consistent' END, CASE WHEN strata_disagree THEN 'no_global_launch' ELSE 'no_objection' END FROM rec
UNION ALL SELECT experiment, treatment, decision, 'power', CASE WHEN underpowered THEN 'underpowered' ELSE 'sufficient' END,
  CASE WHEN underpowered THEN 'redesign' ELSE 'no_objection' END FROM rec
UNION ALL SELECT experiment, treatment, decision, 'guardrails', CASE WHEN n_worse > 0 THEN 'worse' ELSE 'held' END,
  CASE WHEN n_worse > 0 THEN 'do_not_launch' ELSE 'no_objection' END FROM rec
UNION ALL SELECT experiment, treatment, decision, 'subgroups', CASE WHEN n_harmed > 0 THEN 'harmed' ELSE 'none_harmed' END,
  CASE WHEN n_harmed > 0 THEN 'no_global_launch' ELSE 'no_objection' END FROM rec
UNION ALL SELECT experiment, treatment, decision, 'data_quality', CASE WHEN ratio_alarm THEN 'ratio_alarm' WHEN mismatch_rate > 0 THEN 'mismatches_removed'
  ELSE 'clean' END, CASE WHEN ratio_alarm THEN 'redesign' ELSE 'no_objection' END FROM rec""",
)
def st21(spark, sf_dir):
    return decide.decision_matrix(_record(spark, sf_dir), SPEC)


@query(
    "io05_written_result_tables",
    f"""WITH {ORDERS_UNITS}, cells AS ({paired('u', 'converted', 'country')}), {z_test('cells')}
SELECT experiment, country, treatment, {rs('diff', 'z', 'p_value')} FROM zt""",
)
def io05(spark, sf_dir):
    """Write a result table below the shared folder and read it back."""
    tests = proportions.stratified_z(orders_units(spark, sf_dir), SPEC)
    paths = write_tables({"stratified_z": tests}, new_folder(spark, "results"))
    return rounded(
        spark.read.parquet(paths["stratified_z"]).select(
            "experiment", "country", "treatment", "diff", "z", "p_value"
        )
    )


@query("plan_statistical")
def plan_statistical(spark, sf_dir):
    """The whole analysis, step by step, as one long table: step, experiment, row as JSON. It joins the results
    of all other queries of this kind, each of which has its SQL twin."""
    steps = statistical_analysis(
        orders_log(spark, sf_dir), views.user_countries(spark, sf_dir), SPEC, "amount", MIN_EFFECT, GUARDRAILS
    )
    out = None
    for name, table in steps.items():
        row = F.to_json(F.struct(*[c for c in table.columns if c != "experiment"]))
        long = table.select(F.lit(name).alias("step"), "experiment", row.alias("result"))
        out = long if out is None else out.unionByName(long)
    return out

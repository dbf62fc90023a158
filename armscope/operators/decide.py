"""From test results to a decision: practical significance, guardrails, subgroups, matrix and record."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.spec import ExperimentSpec


def practical_significance(z_tests: DataFrame, spec: ExperimentSpec, min_effect: float) -> DataFrame:
    """Place the interval of treatment minus control against the least useful effect.

    ``z_tests`` holds control-minus-treatment intervals, whose ends swap here.
    """
    low, high = -F.col("ci_high"), -F.col("ci_low")
    finding = (
        F.when(high < 0, "harmful")
        .when(high < min_effect, "negligible")
        .when(low >= min_effect, "useful")
        .when(low > 0, "positive_size_open")
        .when(low <= 0, "inconclusive")
    )
    action = (
        F.when(finding.isin("harmful", "negligible"), "stop")
        .when(finding == "useful", "launch")
        .when(finding.isNotNull(), "continue")
    )
    return z_tests.withColumns(
        {
            "effect": -F.col("diff"),
            "effect_low": low,
            "effect_high": high,
            "min_effect": F.lit(float(min_effect)),
            "practical": finding,
            "practical_action": action,
        }
    )


def metric_movement(tests: DataFrame) -> DataFrame:
    """Each metric as better, worse or unclear, from its interval and its good direction."""
    up, down = F.col("ci_low") > 0, F.col("ci_high") < 0
    good_up = F.col("good") > 0
    return tests.withColumn(
        "movement",
        F.when((up & good_up) | (down & ~good_up), "better")
        .when((up & ~good_up) | (down & good_up), "worse")
        .when(F.col("ci_low").isNotNull(), "unclear"),
    )


def guardrail_status(tests: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Any guardrail metric that got worse blocks the launch."""
    moved = metric_movement(tests).filter(F.col("role") == "guardrail")
    return moved.groupBy(*spec.keys, "treatment").agg(
        F.count(F.lit(1)).alias("n_guardrails"),
        F.count_if(F.col("movement") == "worse").alias("n_worse"),
        F.coalesce(F.bool_or(F.col("movement") == "worse"), F.lit(False)).alias("blocks_launch"),
    )


def subgroup_actions(effects: DataFrame) -> DataFrame:
    """Launch where the interval is above 0, hold where it is below, else undecided."""
    return effects.withColumns(
        {
            "harmed": F.col("ci_high_pp") < 0,
            "helped": F.col("ci_low_pp") > 0,
            "action": F.when(F.col("ci_low_pp") > 0, "launch")
            .when(F.col("ci_high_pp") < 0, "hold")
            .otherwise("undecided"),
        }
    )


def subgroup_consistency(effects: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Is any subgroup harmed or helped, and do the point estimates agree in sign?"""
    return (
        subgroup_actions(effects)
        .groupBy(*spec.keys, "treatment")
        .agg(
            F.count(F.lit(1)).alias("n_subgroups"),
            F.count_if("harmed").alias("n_harmed"),
            F.count_if("helped").alias("n_helped"),
            F.bool_or("harmed").alias("any_harmed"),
            (F.min(F.signum("cate_pp")) == F.max(F.signum("cate_pp"))).alias("same_sign"),
        )
    )


def combine(parts: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full join of result tables that have one row per key."""
    return reduce(lambda a, b: a.join(b, list(on), "left"), parts)


def decision_code(
    significant: Column,
    treatment_higher: Column,
    practical: Column,
    guardrail_worse: Column,
    segments_differ: Column,
    underpowered: Column,
    quality_ok: Column,
) -> Column:
    """Rules in order of precedence. A test that failed on quality proves nothing; a worse guardrail
    outweighs the core metric; without significance the size of the interval and the power decide."""
    return (
        F.when(~quality_ok, "redesign")
        .when(guardrail_worse, "do_not_launch")
        .when(significant & ~treatment_higher, "do_not_launch")
        .when(significant & (practical == "negligible"), "do_not_launch")
        .when(significant & segments_differ, "launch_by_segment")
        .when(significant, "launch")
        .when(practical.isin("negligible", "harmful"), "do_not_launch")
        .when(underpowered, "redesign")
        # enough units and still an open interval: no evidence against the effect either
        .otherwise("continue")
    )


def decision_record(
    z_tests: DataFrame,
    simpson: DataFrame,
    power: DataFrame,
    quality: DataFrame,
    spec: ExperimentSpec,
    min_effect: float,
    guardrails: DataFrame | None = None,
    subgroups: DataFrame | None = None,
    auxiliary: DataFrame | None = None,
) -> DataFrame:
    """One row per experiment and treatment: decision, core metric, guardrails, subgroups, risks, next step.

    ``quality`` has ``mismatch_rate``, ``ratio_alarm`` and ``has_date`` per experiment; ``auxiliary``
    has ``aux_p_all`` and ``aux_p_converted``.
    """
    on = [*spec.keys, "treatment"]
    core = practical_significance(z_tests, spec, min_effect).select(
        *on, "n_c", "n_t", "effect", "effect_low", "effect_high", "p_value", "practical"
    )
    parts = [
        core,
        simpson.select(*on, "strata_disagree", "reverses_overall"),
        power.select(*on, "n_required", "shortfall"),
    ]
    if guardrails is not None:
        parts.append(guardrails.select(*on, "n_guardrails", "n_worse"))
    if subgroups is not None:
        parts.append(subgroups.select(*on, "n_subgroups", "n_harmed", "n_helped"))
    out = combine(parts, on).join(
        quality.select(*spec.keys, "mismatch_rate", "ratio_alarm", "has_date"), list(spec.keys), "left"
    )
    if auxiliary is not None:
        own = [*spec.keys, *(c for c in ("treatment",) if c in auxiliary.columns)]
        out = out.join(auxiliary.select(*own, "aux_p_all", "aux_p_converted"), own, "left")
    for name in ("n_guardrails", "n_worse", "n_subgroups", "n_harmed", "n_helped"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0).cast("bigint"))
    for name in ("aux_p_all", "aux_p_converted"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    out = out.fillna(0, ["n_guardrails", "n_worse", "n_subgroups", "n_harmed", "n_helped"])
    out = out.withColumns(
        {
            "significant": F.coalesce(F.col("p_value") < spec.alpha, F.lit(False)),
            "underpowered": F.coalesce(F.col("shortfall") > 1, F.lit(True)),
            "auxiliary_moved": F.coalesce(
                F.least("aux_p_all", "aux_p_converted") < spec.alpha, F.lit(False)
            ),
            "quality_ok": ~F.col("ratio_alarm"),
        }
    )
    segments_differ = F.col("reverses_overall") | (F.col("n_harmed") > 0)
    out = out.withColumn(
        "decision",
        decision_code(
            F.col("significant"),
            F.col("effect") >= 0,
            F.coalesce("practical", F.lit("inconclusive")),
            F.col("n_worse") > 0,
            segments_differ,
            F.col("underpowered"),
            F.col("quality_ok"),
        ),
    )
    next_step = (
        F.when(~F.col("quality_ok"), "repair_assignment_and_rerun")
        .when(F.col("n_worse") > 0, "fix_guardrails")
        .when(F.col("decision") == "launch_by_segment", "launch_helped_segments_only")
        .when(F.col("decision") == "launch", "monitor_after_launch")
        .when(F.col("decision") == "redesign", "plan_sample_for_effect")
        .when(F.col("decision") == "continue", "extend_until_interval_closes")
        .when(F.col("reverses_overall"), "test_reversed_stratum_separately")
        .otherwise("stop_experiment")
    )
    risks = {
        "rows_mismatched": F.col("mismatch_rate") > 0,
        "arm_sizes_off_plan": F.col("ratio_alarm"),
        "no_date": ~F.col("has_date"),
        "confounding_by_stratum": F.col("strata_disagree"),
        "no_subgroup_large_enough": F.col("n_subgroups") == 0,
        "underpowered": F.col("underpowered"),
    }
    named = F.array_compact(F.array(*[F.when(found, name) for name, found in risks.items()]))
    return out.withColumns({"next_step": next_step, "risks": named})


def decision_matrix(record: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """The record as rows: dimension, finding and what it points to."""
    def row(dimension: str, finding: Column, points_to: Column) -> Column:
        return F.struct(
            F.lit(dimension).alias("dimension"), finding.alias("finding"), points_to.alias("points_to")
        )

    rows = [
        row(
            "significance",
            F.when(F.col("significant"), "significant").otherwise("not_significant"),
            F.when(F.col("significant") & (F.col("effect") > 0), "launch")
            .when(F.col("significant"), "do_not_launch")
            .otherwise("no_evidence"),
        ),
        row(
            "effect_size",
            F.coalesce("practical", F.lit("inconclusive")),
            F.when(F.col("practical").isin("negligible", "harmful"), "do_not_launch")
            .when(F.col("practical") == "useful", "launch")
            .otherwise("open"),
        ),
        row(
            "auxiliary_metric",
            F.when(F.col("auxiliary_moved"), "moved").otherwise("not_moved"),
            F.when(F.col("auxiliary_moved"), "review").otherwise("no_gain"),
        ),
        row(
            "simpson",
            F.when(F.col("reverses_overall"), "reversed_stratum")
            .when(F.col("strata_disagree"), "strata_disagree")
            .otherwise("consistent"),
            F.when(F.col("strata_disagree"), "no_global_launch").otherwise("no_objection"),
        ),
        row(
            "power",
            F.when(F.col("underpowered"), "underpowered").otherwise("sufficient"),
            F.when(F.col("underpowered"), "redesign").otherwise("no_objection"),
        ),
        row(
            "guardrails",
            F.when(F.col("n_worse") > 0, "worse").otherwise("held"),
            F.when(F.col("n_worse") > 0, "do_not_launch").otherwise("no_objection"),
        ),
        row(
            "subgroups",
            F.when(F.col("n_harmed") > 0, "harmed").otherwise("none_harmed"),
            F.when(F.col("n_harmed") > 0, "no_global_launch").otherwise("no_objection"),
        ),
        row(
            "data_quality",
            F.when(F.col("ratio_alarm"), "ratio_alarm")
            .when(~F.col("has_date"), "no_date")
            .when(F.col("mismatch_rate") > 0, "mismatches_removed")
            .otherwise("clean"),
            F.when(F.col("ratio_alarm"), "redesign")
            .when(~F.col("has_date"), "cycles_not_excluded")
            .otherwise("no_objection"),
        ),
    ]
    return record.select(*spec.keys, "treatment", "decision", F.inline(F.array(*rows)))

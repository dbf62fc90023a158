"""The whole statistical analysis of a fleet of experiments, from log to decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.operators import decide, design, power, prepare, proportions, ranks, summaries
from armscope.operators.multiple import Metric, metric_tests
from armscope.session import materialise
from armscope.spec import ExperimentSpec


def quality_facts(log: DataFrame, units: DataFrame, spec: ExperimentSpec, has_date: bool) -> DataFrame:
    """Mismatch rate of the log and the sample-ratio alarm of the cleaned units."""
    ratio_check = design.sample_ratio(units, spec).select(
        *spec.keys, F.col("mismatch_alarm").alias("ratio_alarm")
    )
    return (
        prepare.mismatch_share(log, spec)
        .select(*spec.keys, "mismatch_rate")
        .join(ratio_check, list(spec.keys), "left")
        .withColumn("has_date", F.lit(has_date))
        .fillna(False, ["ratio_alarm"])
    )


def auxiliary_tests(units: DataFrame, spec: ExperimentSpec, value: str) -> DataFrame:
    """Rank tests of an auxiliary metric over all units and over converted units, in one ranking."""
    both = F.array(
        F.lit("all"), F.when(F.col(spec.metric) == 1, "converted")
    )
    scoped = units.select(*spec.keys, spec.arm, value, F.explode(both).alias("scope")).filter(
        F.col("scope").isNotNull()
    )
    tests = ranks.mann_whitney(scoped, spec, value, by=["scope"])
    own = [*spec.keys, *(c for c in ("treatment",) if c in tests.columns)]
    return tests.groupBy(*own).agg(
        *[F.max(F.when(F.col("scope") == s, F.col("p_value"))).alias(f"aux_p_{s}") for s in ("all", "converted")]
    )


def record_for(
    log: DataFrame,
    units: DataFrame,
    spec: ExperimentSpec,
    min_effect: float,
    auxiliary: str,
    guardrails: Sequence[Metric] = (),
    has_date: bool = True,
) -> DataFrame:
    """All test results of cleaned units joined into decision records.

    Rates, strata, power and subgroups come from one table of cells: the units are read for those, for the
    guardrails and for the ranks, once each.
    """
    stored = summaries.cells(units, spec, [spec.stratum])
    tests = metric_tests(units, spec, guardrails) if guardrails else None
    return decide.decision_record(
        z_tests=proportions.two_proportion_z(stored, spec),
        simpson=proportions.simpson_check(stored, spec),
        power=power.target_shortfall(power.baselines(stored, spec), spec),
        quality=quality_facts(log, units, spec, has_date),
        spec=spec,
        min_effect=min_effect,
        guardrails=decide.guardrail_status(tests, spec) if tests is not None else None,
        subgroups=decide.subgroup_consistency(
            proportions.subgroup_effects(stored, spec, [spec.stratum]), spec
        ),
        auxiliary=auxiliary_tests(units, spec, auxiliary),
    )


def statistical_analysis(
    log: DataFrame,
    countries: DataFrame,
    spec: ExperimentSpec,
    auxiliary: str,
    min_effect: float = 0.001,
    guardrails: Sequence[Metric] = (),
    has_date: bool = True,
) -> dict[str, DataFrame]:
    """Every step's result table, by name. The cleaned units are written out once and reused."""
    units = materialise(prepare.prepare(log, countries, spec))
    stored = summaries.cells(units, spec, [spec.stratum])
    base = power.baselines(stored, spec)
    record = record_for(log, units, spec, min_effect, auxiliary, guardrails, has_date)
    return {
        "mismatches": prepare.mismatch_counts(log, spec),
        "duplicates": prepare.duplicate_counts(prepare.drop_mismatched(log, spec), spec),
        "arm_summary": summaries.arm_summary(units, spec),
        "stratum_summary": summaries.arm_summary(units, spec, by=[spec.stratum]),
        "lift": proportions.lift(stored, spec),
        "z_test": proportions.two_proportion_z(stored, spec),
        "stratified_z": proportions.stratified_z(stored, spec),
        "simpson": proportions.simpson_check(stored, spec),
        "auxiliary": auxiliary_tests(units, spec, auxiliary),
        "sample_sizes": power.sample_sizes(base, spec),
        "power_curve": power.power_curve(base, spec),
        "decision": record,
        "decision_matrix": decide.decision_matrix(record, spec),
    }

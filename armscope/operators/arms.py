"""Operators that compare two arms, applied to every treatment of an experiment."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armscope.spec import ExperimentSpec

PAIR = "treatment"


def paired_rows(df: DataFrame, spec: ExperimentSpec, arm: str | None = None) -> DataFrame:
    """Each row once for every comparison it belongs to, named in ``treatment``: the control's rows go into all."""
    arm = arm or spec.arm
    mine = F.when(F.col(arm) == spec.control, F.array(*[F.lit(t) for t in spec.treatments])).when(
        F.col(arm).isin(*spec.treatments), F.array(F.col(arm))
    )
    label = F.when(F.col(arm) == spec.control, F.col(arm)).otherwise(F.lit(PAIR))
    return df.withColumn(PAIR, F.explode(mine)).withColumn(arm, label)


def each_treatment(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """With several treatments, one result per treatment, told apart by the column ``treatment``.

    All comparisons run in the same pass: the treatment joins the experiment's keys. With one treatment
    the operator is left as it is.
    """

    @functools.wraps(operator)
    def run(df: DataFrame, spec: ExperimentSpec, *args, **kwargs) -> DataFrame:
        if len(spec.treatments) == 1:
            return operator(df, spec, *args, **kwargs)
        own = replace(spec, keys=(*spec.keys, PAIR), treatments=(PAIR,))
        return operator(paired_rows(df, spec), own, *args, **kwargs)

    return run

"""Effect sizes, and codes for verdicts and directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (ANSI mode would raise)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def at_least(value: Column, low: float) -> Column:
    """The greater of both; null stays null (``greatest`` would skip it)."""
    return F.when(value >= low, value).when(value < low, F.lit(float(low)))


def at_most(value: Column, high: float) -> Column:
    return F.when(value <= high, value).when(value > high, F.lit(float(high)))


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def verdict(p_value: Column, alpha: float) -> Column:
    return F.when(p_value < alpha, "significant").when(p_value >= alpha, "not_significant")


def direction(p_control: Column, p_treatment: Column) -> Column:
    """Which arm is higher; a tie counts for the treatment."""
    return F.when(p_control > p_treatment, "control_higher").when(
        p_control <= p_treatment, "treatment_higher"
    )

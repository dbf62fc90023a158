"""Names and parameters of an experiment, so that no operator hard-codes a column."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist


@dataclass(frozen=True)
class ExperimentSpec:
    """Column names, arm labels and test parameters shared by all operators.

    ``keys`` are the columns that identify an experiment. Every operator groups by them,
    so one DataFrame may hold a whole fleet of experiments.
    """

    keys: tuple[str, ...] = ("experiment",)
    unit: str = "user_id"
    arm: str = "group"
    control: str = "control"
    treatments: tuple[str, ...] = ("treatment",)
    page: str = "landing_page"
    arm_pages: dict[str, str] = field(
        default_factory=lambda: {"control": "old_page", "treatment": "new_page"}
    )
    metric: str = "converted"
    stratum: str = "country"
    time: str = "time_seconds"
    # First exposure is decided by these columns; together they must be unique per unit.
    order: tuple[str, ...] = ("ts", "seq")
    alpha: float = 0.05
    power: float = 0.80
    # 1.96 rather than the exact quantile, the usual rounded constant.
    ci_z: float = 1.96
    # A gain of the treatment whose upper bound is below this many percentage points is negligible.
    negligible_pp: float = 0.1
    min_cell: int = 100
    # Planned shares of the control and the treatments, in their order; equal unless given.
    shares: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if self.shares and len(self.shares) != len(self.arms):
            raise ValueError("one share for the control and one for each treatment")

    @property
    def arms(self) -> tuple[str, ...]:
        return (self.control, *self.treatments)

    @property
    def planned_shares(self) -> dict[str, float]:
        """Share of each arm; they sum to 1."""
        shares = self.shares or (1.0,) * len(self.arms)
        return {arm: share / sum(shares) for arm, share in zip(self.arms, shares)}

    @property
    def z_alpha(self) -> float:
        return NormalDist().inv_cdf(1 - self.alpha / 2)

    @property
    def z_power(self) -> float:
        return NormalDist().inv_cdf(self.power)

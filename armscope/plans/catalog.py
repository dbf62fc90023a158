"""Collects all catalogue modules."""

from armscope.plans import cat_clean, cat_decide, cat_design, cat_effects, cat_fleet, cat_models, cat_power, cat_stream  # noqa: F401
from armscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

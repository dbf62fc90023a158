"""armscope: controlled-experiment analysis on Spark DataFrames."""

from armscope.spec import ExperimentSpec

__all__ = ["ExperimentSpec"]

"""Catalogue of named queries; a query may carry SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from armscope.operators import prepare as prep
from armscope.sources import views
from armscope.spec import ExperimentSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPEC = ExperimentSpec()
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round floating columns: engines add in different orders."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in floats}) if floats else df


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.order_exposures(spark, sf_dir)


def orders_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned orders experiment: one row per user with its country."""
    return prep.prepare(orders_log(spark, sf_dir), views.user_countries(spark, sf_dir), SPEC)


def fleet_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned units of several experiments in one table."""
    return prep.prepare(
        views.fleet_exposures(spark, sf_dir), views.user_countries(spark, sf_dir), SPEC
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_exposures(spark, sf_dir)


def events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned events experiment at event grain, with the country of the user."""
    return prep.attach_dimension(
        prep.drop_mismatched(events_log(spark, sf_dir), SPEC), views.user_countries(spark, sf_dir), SPEC
    )


def events_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.add_features(events_rows(spark, sf_dir), SPEC, REGIONS, compat=True)


def prepost_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.attach_dimension(
        views.pre_post_units(spark, sf_dir), views.user_countries(spark, sf_dir), SPEC
    )

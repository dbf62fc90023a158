"""Scans with declared schemas, table profiles and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

# One row per exposure. Time of day arrives as text when there is no date.
EXPOSURE_LOG = StructType(
    [
        StructField("user_id", LongType()),
        StructField("timestamp", StringType()),
        StructField("group", StringType()),
        StructField("landing_page", StringType()),
        StructField("converted", IntegerType()),
    ]
)
COUNTRY_DIMENSION = StructType([StructField("user_id", LongType()), StructField("country", StringType())])


def read_table(
    spark: SparkSession, path: str, schema: StructType | None = None, fmt: str | None = None
) -> DataFrame:
    """Read parquet, orc, csv or json; the format follows from the file name unless given.

    Text formats need a schema, so that no inference pass runs over the data.
    """
    fmt = fmt or next((f for f in ("csv", "json", "orc") if path.rstrip("/").endswith(f)), "parquet")
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true").option("mode", "FAILFAST")
    return reader.load(path)


def read_exposures(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return read_table(spark, path, EXPOSURE_LOG, fmt)


def read_countries(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return read_table(spark, path, COUNTRY_DIMENSION, fmt)


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count and column list of each named table."""
    rows = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            F.lit(",".join(df.columns)).alias("column_names"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def sample_values(df: DataFrame, column: str, order: list[str], k: int = 5) -> DataFrame:
    """The first ``k`` values in a stated order, with their type (a top-k report)."""
    kind = df.schema[column].dataType.simpleString()
    return (
        df.select(*dict.fromkeys([*order, column]))
        .orderBy(*order)
        .limit(k)
        .withColumn("data_type", F.lit(kind))
    )


def write_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "overwrite") -> dict[str, str]:
    """Write each result table as parquet below ``folder``; returns the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(paths[name])
    return paths

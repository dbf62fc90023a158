"""Experiment-shaped views over the star-schema tables: logs, country dimension, pre/post units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armscope.functions.hashing import hash_arm
from armscope.functions.timing import seconds_of_hour

SALT = "exp1"
SPLIT_DAY = "2024-01-16"


# Declared, so that planning a query reads no file footers.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _page(flipped):
    seen_new = (F.col("group") == "treatment") != flipped
    return F.when(seen_new, "new_page").otherwise("old_page")


def once_per_row(**columns):
    """Columns from a generator of one row, which the optimizer does not copy into filters.

    A filter moves below a plain projection together with the expressions it uses, so a hash would be
    computed again for every mention. A constant experiment name stays a column here, so that grouping
    and joining by it are planned as for a log that holds many.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def _exposures_of_orders(orders: DataFrame, experiment, salt) -> DataFrame:
    keyed = orders.select("*", once_per_row(experiment=experiment, group=hash_arm(salt, F.col("o_custkey"))))
    return keyed.select(
        "experiment",
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("ts"),
        "group",
        (F.col("o_orderstatus") == "F").cast("int").alias("converted"),
        F.col("o_totalprice").alias("amount"),
        _page(F.col("o_orderkey") % 73 == 0).alias("landing_page"),
    )


def order_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; the page contradicts the arm on every 73rd order key."""
    return _exposures_of_orders(table(spark, sf_dir, "orders"), F.lit("orders"), SALT)


def fleet_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many experiments in one log: each order priority is one, with its own assignment salt."""
    priority = F.col("o_orderpriority")
    return _exposures_of_orders(table(spark, sf_dir, "orders"), priority, priority)


def event_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; the page contradicts the arm where the payload's k is 0."""
    return as_exposures(table(spark, sf_dir, "events"))


def as_exposures(events: DataFrame) -> DataFrame:
    """The exposure columns of an events table, batch or stream."""
    keyed = events.select(
        "*",
        once_per_row(
            experiment=F.lit("events"),
            group=hash_arm(SALT, F.col("user_id")),
            k=F.get_json_object("props", "$.k").cast("int"),
        ),
    )
    return keyed.select(
        "experiment",
        F.col("event_id").alias("seq"),
        "user_id",
        "ts",
        "group",
        "k",
        (F.col("event_type") == "purchase").cast("int").alias("converted"),
        "event_type",
        "value",
        _page(F.col("k") == 0).alias("landing_page"),
        seconds_of_hour(F.col("ts")).alias("time_seconds"),
    )


def user_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id -> country (the region name of the customer's nation)."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("user_id"), F.col("r_name").alias("country"))
    )


def user_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id -> nation key, the cluster of cluster-randomised designs."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("cluster")
    )


def pre_post_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: value before and after the split day, and counts after it."""
    events = table(spark, sf_dir, "events")
    late = F.col("ts") >= F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return (
        events.groupBy("user_id")
        .agg(
            F.coalesce(F.sum(F.when(~late, F.col("value"))), F.lit(0.0)).alias("pre"),
            F.coalesce(F.sum(F.when(late, F.col("value"))), F.lit(0.0)).alias("post"),
            F.count_if(late).alias("n_events"),
            F.count_if(late & (F.col("event_type") == "purchase")).alias("purchases"),
            F.count_if(late & (F.col("event_type") == "error")).alias("errors"),
        )
        .select("*", once_per_row(experiment=F.lit("events"), group=hash_arm(SALT, F.col("user_id"))))
    )


def user_edges(spark: SparkSession, sf_dir: str, steps: tuple[int, ...] = (1, 7)) -> DataFrame:
    """A sparse neighbour graph of customers: each key with the keys ``steps`` further on."""
    customer = table(spark, sf_dir, "customer")
    ahead = F.array(*[F.col("c_custkey") + s for s in steps])
    return customer.select(F.col("c_custkey").alias("src"), F.explode(ahead).alias("dst"))


def list_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events on two interleaved lists: the parity of the payload's k names the list."""
    clicks = event_exposures(spark, sf_dir).filter("event_type = 'click'")
    return clicks.withColumn("list", F.when(F.col("k") % 2 == 0, "A").otherwise("B"))

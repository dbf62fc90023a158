"""Tree ensembles as tables: a row a node, from which importances are ordinary aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.effects import ratio
from armscope.session import new_folder


def tree_nodes(model, spark, names: Sequence[str]) -> DataFrame:
    """(tree, node, feature, threshold, gain, weight, n, left, right, prediction) of a fitted forest or boosting.

    The ensemble is saved to the shared folder and read as the table that MLlib writes. gain is the impurity that a
    split takes away, weight the node's weight in the training rows, n their number. Leaves have null feature,
    threshold, gain and children.
    """
    path = new_folder(spark, "trees")
    model.write().save(path)
    raw = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    split = F.col("leftChild") >= 0
    # classification nodes have a weight for each class, regression nodes weight, sum and sum of squares
    total = F.aggregate("impurityStats", F.lit(0.0), lambda s, v: s + v)
    weight = total if _classifies(model) else F.col("impurityStats")[0]
    named = F.array(*[F.lit(n) for n in names])
    return raw.select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(split, named[F.col("split.featureIndex")]).alias("feature"),
        F.when(split, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(split, F.col("gain")).alias("gain"),
        weight.alias("weight"),
        F.col("rawCount").alias("n"),
        F.when(split, F.col("leftChild")).alias("left"),
        F.when(split, F.col("rightChild")).alias("right"),
        "prediction",
    )


def _classifies(model) -> bool:
    """Are the single trees classifiers? Boosting classifiers are sums of regression trees."""
    return "Classif" in type(model.trees[0]).__name__


def node_importances(nodes: DataFrame, names: Sequence[str], each_tree_counts_alike: bool) -> DataFrame:
    """(feature, importance, importance_norm, kind, splits, total_gain, gain_per_split, importance_rank) of all names.

    total_gain: gain times weight over a feature's splits. importance: its share of the total, in boosting over
    all trees together, in a forest (``each_tree_counts_alike``) as the mean of the trees' shares. A feature that
    no tree splits on has 0, and null gain a split.
    """
    worth = F.col("gain") * F.col("weight")
    by_tree = nodes.where(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(
        F.sum(worth).alias("gain"), F.count(F.lit(1)).alias("splits")
    )
    share = F.col("gain")
    if each_tree_counts_alike:
        share = F.coalesce(ratio(share, F.sum("gain").over(Window.partitionBy("tree"))), F.lit(0.0))
    found = by_tree.withColumn("share", share).groupBy("feature").agg(
        F.sum("share").alias("share"), F.sum("gain").alias("total_gain"), F.sum("splits").alias("splits")
    )
    known = nodes.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    whole = Window.partitionBy()  # one row a feature
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    importance = zero(ratio(F.col("share"), F.sum("share").over(whole)))
    kind = (
        F.when(F.col("feature") == "is_treatment", "main")
        .when(F.col("feature").contains("treatment_x"), "interaction")
        .otherwise("control")
    )
    table = known.join(found, "feature", "left").select(
        "feature",
        importance.alias("importance"),
        importance.alias("importance_norm"),
        kind.alias("kind"),
        F.coalesce("splits", F.lit(0)).cast("bigint").alias("splits"),
        zero(F.col("total_gain")).alias("total_gain"),
        ratio(F.col("total_gain"), F.col("splits")).alias("gain_per_split"),
    )
    order = Window.orderBy(F.col("importance").desc(), "feature")
    return table.withColumn("importance_rank", F.row_number().over(order))

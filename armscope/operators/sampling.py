"""Seeded samples and folds: reproducible from the unit ids, whatever the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.functions.hashing import hash_number

_CELLS = 4096
# Of the 32 bits of a hash: 12 name the cell, the next 10 the part of a cell, the last 10 are the rest.
_FINE_BITS, _REST_BITS = 10, 10


def fixed_size_sample(
    df: DataFrame, groups: Sequence[str], unit: Sequence[str], k: int, seed: int = 42, strict: bool = False
) -> DataFrame:
    """Exactly ``k`` rows of every group: those with the smallest seeded hash of ``unit``.

    A histogram of the hash's first 12 bits finds the cell in which a group's k-th row lies; a second one, of the
    next 10 bits in that cell only, the part of it. Rows below that part need no rank; only its own rows, a
    four-millionth of a large group, are ranked. Groups with fewer rows give all they have; ``strict`` drops such
    groups instead. Nothing is written before the action.
    """
    groups, unit = list(groups), list(unit)
    key = F.struct(*groups) if groups else F.struct(F.lit(0))
    hashed = df.withColumn("_hash", hash_number(str(seed), *[F.col(c) for c in unit])).withColumn("_key", key)
    hashed = hashed.withColumns(
        {"_cell": F.shiftright("_hash", _FINE_BITS + _REST_BITS), "_part": F.shiftright("_hash", _REST_BITS)}
    )

    def cut(rows: DataFrame, by: str, wanted: Column, carried: Sequence[str]) -> DataFrame:
        """(_key, <by>_cut, <by>_below, size): where row ``wanted`` lies, and the rows before that place."""
        upto = Window.partitionBy("_key").orderBy(by)
        counts = rows.groupBy("_key", by, *carried).agg(F.count(F.lit(1)).alias("_n"))
        summed = counts.withColumns({"_upto": F.sum("_n").over(upto), "_size": F.sum("_n").over(Window.partitionBy("_key"))})
        reached = F.when(F.col("_upto") >= wanted, F.struct(by, (F.col("_upto") - F.col("_n")).alias("_below")))
        first = F.min(reached).alias("_first")
        return summed.groupBy("_key").agg(first, F.max("_size").alias("_size"), *[F.max(c).alias(c) for c in carried]).select(
            "_key", F.col(f"_first.{by}").alias(f"{by}_cut"), F.col("_first._below").alias(f"{by}_below"), "_size", *carried
        )

    coarse = cut(hashed, "_cell", F.lit(k), [])
    if strict:
        coarse = coarse.where(F.col("_size") >= k)
    # a group without a k-th row gives all its rows: its cut is null
    small = coarse.where("_cell_cut IS NULL").select("_key", F.lit(None).cast("bigint").alias("_part_cut"), F.lit(0).cast("bigint").alias("_left"))
    large = coarse.where("_cell_cut IS NOT NULL").select("_key", "_cell_cut", "_cell_below")
    inside = hashed.select("_key", "_cell", "_part").join(large, "_key").where("_cell = _cell_cut")
    fine = cut(inside, "_part", k - F.col("_cell_below"), ["_cell_below"])
    left = (F.lit(k) - F.col("_cell_below") - F.col("_part_below")).cast("bigint").alias("_left")
    cuts = small.unionByName(fine.select("_key", F.col("_part_cut").cast("bigint").alias("_part_cut"), left))
    near = hashed.join(cuts, "_key").where("_part_cut IS NULL OR _part <= _part_cut")
    at_cut = F.coalesce(F.col("_part") == F.col("_part_cut"), F.lit(False))
    ranked = near.where(at_cut).withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy("_hash", *unit)))
    return near.where(~at_cut).select(*df.columns).unionByName(ranked.where("_rank <= _left").select(*df.columns))


def hash_folds(df: DataFrame, unit: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Fold number by hash: no shuffle, strata balanced up to chance."""
    return df.withColumn(
        "fold", (hash_number(f"fold{seed}", *[F.col(c) for c in unit]) % folds).cast("int")
    )


def stratified_folds(
    df: DataFrame, groups: Sequence[str], label: str, unit: Sequence[str], folds: int = 5, seed: int = 42
) -> DataFrame:
    """Fold sizes equal to within one row inside every label class, dealt in hash order.

    A row's position in its class is the number of rows in smaller cells of the hash, from a histogram, and its
    place inside its own cell. So a class of any size spreads over the cells, nothing is written before the
    action, and only the columns that the caller goes on to read are moved.
    """
    cell, classes = "_cell", [*groups, label]
    hashed = df.withColumn("_hash", hash_number(f"fold{seed}", *[F.col(c) for c in unit]))
    hashed = hashed.withColumn(cell, F.floor(F.col("_hash") / (2**32 // _CELLS)).cast("int"))
    before = Window.partitionBy(*classes).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    histogram = hashed.groupBy(*classes, cell).agg(F.count(F.lit(1)).alias("_n"))
    firsts = histogram.select(*classes, cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    # one column that holds the keys: its comparison matches nulls, and rows stay where the window wants them
    key = F.struct(*classes, cell).alias("_key")
    place = Window.partitionBy("_key").orderBy("_hash", *unit)
    placed = hashed.withColumn("_key", key).withColumn("_place", F.row_number().over(place) - 1)
    fold = ((F.col("_first") + F.col("_place")) % folds).cast("int").alias("fold")
    return placed.join(firsts.select(key, "_first"), "_key").select(*df.columns, fold)


def stratified_sample(
    df: DataFrame,
    groups: Sequence[str],
    stratum: str,
    unit: Sequence[str],
    per_stratum: int,
    seed: int = 42,
) -> DataFrame:
    """A fixed quota of rows from every stratum."""
    return fixed_size_sample(df, [*groups, stratum], unit, per_stratum, seed)


def poststratification_weights(
    sample: DataFrame, population: DataFrame, groups: Sequence[str], stratum: str
) -> DataFrame:
    """Population share, sample share and the weight that turns one into the other, per stratum."""
    cells = [*groups, stratum]
    whole = Window.partitionBy(*groups)
    shares = []
    for df, name in ((population, "population"), (sample, "sample")):
        counted = df.groupBy(*cells).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        shares.append(
            counted.withColumn(f"{name}_share", F.col(f"n_{name}") / F.sum(f"n_{name}").over(whole))
        )
    found = shares[1].select(F.struct(*cells).alias("_key"), "n_sample", "sample_share")  # a struct matches null strata
    both = shares[0].withColumn("_key", F.struct(*cells)).join(found, "_key", "left").drop("_key")
    return both.withColumn("weight", F.try_divide(F.col("population_share"), F.col("sample_share")))

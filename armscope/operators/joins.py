"""Joining a table that has one row per group back to the rows of the groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armscope.session import materialise

BROADCAST_ROWS = 200_000


def same_keys(groups: Sequence[str], prefix: str) -> Column:
    """Join condition: each group column equals ``<prefix><its position>``; null keys match null keys."""
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"{prefix}{i}"))
    return same


def attach_per_group(
    rows: DataFrame, per_group: DataFrame, groups: Sequence[str], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add the columns of ``per_group`` to all rows of its group; null keys match null keys.

    The small table is written out and counted first. Up to ``broadcast_rows`` rows it is broadcast, so
    the rows are not shuffled and a group holding most of them stays spread; beyond that it is an
    ordinary join, in which adaptive execution splits large groups.
    """
    small = materialise(
        per_group.select(
            *[F.col(g).alias(f"_key{i}") for i, g in enumerate(groups)],
            *[c for c in per_group.columns if c not in groups],
        )
    )
    if small.count() <= broadcast_rows:
        small = F.broadcast(small)
    return rows.join(small, same_keys(groups, "_key")).drop(*[f"_key{i}" for i in range(len(groups))])

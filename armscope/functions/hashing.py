"""Deterministic hashes of unit ids: the same on every run, partitioning and engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(salt: str | Column, *parts: Column) -> Column:
    """First 32 bits of md5(salt:part:...), as a long in [0, 2^32)."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    text = F.concat_ws(":", salt, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_arm(salt: str | Column, unit: Column, arms: Sequence[str] = ("control", "treatment")) -> Column:
    """Equal split over ``arms`` by hash modulo."""
    slot = hash_number(salt, unit) % len(arms)
    return F.element_at(F.array(*[F.lit(a) for a in arms]), (slot + 1).cast("int"))


def split_arm(
    salt: str | Column, unit: Column, shares: Sequence[tuple[str, float]], slots: int = 10_000
) -> Column:
    """Split by cumulative shares over ``slots`` hash slots, e.g. 70:30 or 90:10."""
    slot = hash_number(salt, unit) % slots
    total = sum(share for _, share in shares)
    reached, choice = 0.0, None
    for arm, share in shares:
        reached += share
        limit = round(slots * reached / total)
        choice = F.when(slot < limit, arm) if choice is None else choice.when(slot < limit, arm)
    return choice

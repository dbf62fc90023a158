"""Time of day in seconds and the two bucket conventions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges of the right-closed minute buckets, coded 0 to 6.
MINUTE_EDGES = (0, 10, 20, 30, 40, 50, 60, 90)
# Half-open ten-minute buckets up to one hour.
BUCKET_MINUTES = 10
LAST_MINUTE = 60


def seconds_of_day(ts: Column, compat: bool = False) -> Column:
    """hour * 3600 + minute * 60 + second with its fraction, of a timestamp column."""
    seconds = (
        F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    )
    return F.coalesce(seconds, F.lit(0.0)) if compat else seconds


def seconds_of_hour(ts: Column) -> Column:
    """Seconds since the full hour: how far into its hour an exposure falls."""
    return F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def seconds_of_text(text: Column, compat: bool = False) -> Column:
    """The same for ``HH:MM:SS(.f)`` strings. Text that does not parse is null, or 0 in compat mode."""
    parts = F.split(text, ":")
    seconds = (
        F.get(parts, F.lit(0)).try_cast("int") * 3600
        + F.get(parts, F.lit(1)).try_cast("int") * 60
        + F.get(parts, F.lit(2)).try_cast("double")
    )
    return F.coalesce(seconds, F.lit(0.0)) if compat else seconds


def right_closed_bucket(minutes: Column, edges=MINUTE_EDGES, compat: bool = False) -> Column:
    """Index of the interval (edge, next edge] holding ``minutes``.

    Outside all intervals: null, or 0 in compat mode, which then mixes with the first interval.
    """
    ladder = F.when(minutes <= edges[0], None)
    for index, edge in enumerate(edges[1:]):
        ladder = ladder.when(minutes <= edge, index)
    bucket = ladder.cast("int")
    return F.coalesce(bucket, F.lit(0)) if compat else bucket


def half_open_bucket(minutes: Column, width: int = BUCKET_MINUTES, last: int = LAST_MINUTE) -> Column:
    """Lower edge of [k*width, (k+1)*width); null outside [0, last)."""
    return F.when((minutes >= 0) & (minutes < last), (F.floor(minutes / width) * width).cast("int"))


def bucket_label(lower: Column, width: int = BUCKET_MINUTES) -> Column:
    return F.concat(lower.cast("string"), F.lit("-"), (lower + width).cast("string"))

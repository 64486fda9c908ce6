"""Time expressions that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_since_1970(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds_since_2000(ts: Column) -> Column:
    """Seconds since 2000-01-01 (with fraction) of a timestamp without zone."""
    return (
        F.timestamp_diff("MICROSECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
        / F.lit(1e6)
    )

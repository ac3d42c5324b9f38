"""Which columns play which part, so that no operator is bound to a data set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """Columns of an event table: ``time`` is a whole number of ticks, ``id`` breaks ties."""

    key: str = "key"
    time: str = "t"
    id: str = "id"
    amount: str = "amt"
    target: str = "y"


def seconds(timestamp: Column | str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    column = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def micros(timestamp: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    column = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column.cast("timestamp_ntz"))

"""Sides of joins that are sent to all executors, by their measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most narrow rows that are sent.
MOST = 200_000


def sent(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows with a broadcast hint if there are at most so many, else as they are, to be joined by a shuffle."""
    most = MOST if most is None else most
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows

"""Broadcasts of tables whose size a count has proved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast table may have.
MOST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = MOST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, so that Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shipped(dimension: DataFrame, rows: int = MOST_ROWS) -> list:
    """The rows of a dimension table, for tasks that need it as arrays; an error if there are more than ``rows``."""
    found = dimension.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows are no dimension")
    return found

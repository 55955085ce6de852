"""Joins with a side that may be small: broadcast behind a check of its size, shuffled beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows (counted now, stopping there); else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

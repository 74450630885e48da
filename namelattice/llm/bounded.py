"""Broadcasts with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is: a shuffle join, whose hot keys the adaptive planner splits."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

"""Broadcasts only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a side may have to be broadcast. At a few hundred bytes a row this stays far below the
# limit of a broadcast table.
BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than ``max_rows + 1`` of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def hinted(df: DataFrame, small: bool) -> DataFrame:
    """Hint a broadcast for a side whose bound was checked on the table it derives from."""
    return F.broadcast(df) if small else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the row count was checked; otherwise leave a shuffle join."""
    return F.broadcast(df) if is_small(df, max_rows) else df

"""Names for helper columns that no column of a frame has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused_prefix(df: DataFrame) -> str:
    """Underscores with which no column begins."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix

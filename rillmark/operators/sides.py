"""Choosing how a side of a join travels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a request side that may be broadcast; a larger one shuffles.
FEW = 200_000


def is_few(df: DataFrame, rows: int = FEW) -> bool:
    return df.limit(rows + 1).count() <= rows


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """A broadcast of ``df`` if it is counted to have at most ``rows`` rows, else ``df``.
    The count stops at one row more."""
    return F.broadcast(df) if is_few(df, rows) else df

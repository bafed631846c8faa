"""Sorting with the engine's null order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(column: str | Column, descending: bool = False) -> Column:
    """A sort key: nulls last when ascending, first when descending."""
    c = F.col(column) if isinstance(column, str) else column
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def top_k(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows by ``keys``: each task keeps ``n``, one merges them."""
    return df.orderBy(*keys).limit(n)

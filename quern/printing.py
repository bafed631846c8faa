"""Results as text."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def months(n: int) -> str:
    """A number of months as years and months."""
    sign, n = ("-", -n) if n < 0 else ("", n)
    return f"{sign}{n // 12} years {n % 12} months"


def iso_duration(d: datetime.timedelta) -> str:
    """A duration as ISO 8601 has it."""
    seconds = int(d.total_seconds())
    sign, seconds = ("-", -seconds) if seconds < 0 else ("", seconds)
    hours, rest = divmod(seconds, 3600)
    parts = [f"{n}{u}" for n, u in ((hours, "H"), (rest // 60, "M"), (rest % 60, "S")) if n]
    return f"{sign}PT{''.join(parts) or '0S'}"


def cell(value: Any) -> str:
    if value is None:
        return "[null]"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime.timedelta):
        return iso_duration(value)
    return str(value)


def printable(df: DataFrame) -> DataFrame:
    """The rows with month intervals as numbers, which can be collected."""
    fields = [f for f in df.schema if isinstance(f.dataType, T.YearMonthIntervalType)]
    for f in fields:
        df = df.withColumn(f.name, df[f.name].cast(T.YearMonthIntervalType(1, 1)).cast("int"))
    return df


def lines(df: DataFrame, limit: int | None = None) -> list[str]:
    """A header and rows, tab-separated; ``limit`` rows at most."""
    interval = {f.name for f in df.schema if isinstance(f.dataType, T.YearMonthIntervalType)}
    rows = printable(df if limit is None else df.limit(limit)).collect()
    show = lambda name, v: months(v) if name in interval and v is not None else cell(v)
    return ["\t".join(df.columns), *("\t".join(show(n, v) for n, v in zip(df.columns, r)) for r in rows)]

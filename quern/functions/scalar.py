"""Scalar functions that Spark does not have as such."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType


def int_divide(a: str, b: str) -> Column:
    """Quotient of two integer expressions, cut towards zero: a long."""
    return F.expr(f"({a}) DIV ({b})")


def int_equals(a: Column, b: Column) -> Column:
    """1 if equal, 0 if not, null if one is null."""
    return (a == b).cast("int")


def register_aggregate(spark: SparkSession, name: str, function: Callable, returns: str) -> None:
    """Make a function of pandas Series callable from SQL as an aggregate, ``returns`` its type.

    It gets a group's values at once; what sums, counts and sketches can express is better
    written with those, which combine before the shuffle.
    """

    def apply(*columns: pd.Series):
        return function(*columns)

    # the kind of function is told from its signature
    apply.__annotations__ = {"return": object}
    spark.udf.register(name, F.pandas_udf(apply, returns, PandasUDFType.GROUPED_AGG))


def register_table_function(spark: SparkSession, name: str, function: Callable[..., Iterable[tuple]], returns: str) -> None:
    """Make a function that gives rows callable in FROM, also LATERAL; ``returns`` their schema."""

    class Rows:
        def eval(self, *values):
            yield from function(*values)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))


def register_functions(spark: SparkSession) -> None:
    """Make the functions callable from SQL, as native expressions that Catalyst inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION int_equals(a INT, b INT) RETURNS INT RETURN CAST(a = b AS INT)")

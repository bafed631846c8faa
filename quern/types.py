"""Column types: the spellings that table definitions use."""

from __future__ import annotations

from pyspark.sql import types as T

# The accepted spellings and what they mean.
SPELLINGS: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "byte": T.ByteType(),
    "int": T.IntegerType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "numeric": T.DoubleType(),
    "char": T.StringType(),
    "character": T.StringType(),
    "character varying": T.StringType(),
    "varchar": T.StringType(),
    "text": T.StringType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "time": T.TimeType(0),
    "timestamp": T.TimestampNTZType(),
}


def spark_type(spelling: str) -> T.DataType:
    """The type of a spelling; lengths such as ``varchar(10)`` don't matter."""
    name = " ".join(spelling.lower().split("(")[0].split())
    if name not in SPELLINGS:
        raise ValueError(f"unknown type: {spelling}")
    return SPELLINGS[name]

"""Files as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that the CSV reader parses itself; times are cast from text.
_CAST = (T.TimeType,)


def read_parquet(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table stored as ``root/name.parquet``, a file or a folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def write_parquet(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def register(spark: SparkSession, root: str, names: Iterable[str]) -> None:
    """Temporary views of the tables under ``root``."""
    for name in names:
        read_parquet(spark, root, name).createOrReplaceTempView(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, separator: str = ",", null: str = "NULL") -> DataFrame:
    """Lines without header by the types of ``schema``.

    Empty fields, quoted or not, and the ``null`` token are null; a value that its type
    cannot hold, or a wrong number of fields, fails the read.
    """
    if len(separator) != 1:
        raise ValueError("the separator is one character")
    raw = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, _CAST) else f.dataType) for f in schema])
    df = spark.read.csv(path, schema=raw, sep=separator, nullValue=null, header=False, mode="FAILFAST", enforceSchema=True, emptyValue="")
    columns = []
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        elif isinstance(f.dataType, _CAST):
            c = F.nullif(c, F.lit("")).cast(f.dataType)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, *, separator: str = ",", null: str = "NULL") -> None:
    df.write.mode("overwrite").csv(path, sep=separator, nullValue=null, header=False)

"""op10: near-duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .simhash import near_duplicates


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, max_bits=4)


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}

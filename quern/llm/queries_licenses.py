"""op7: licences named in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .licenses import scan

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keys=["doc_id"], text_col="text", phrases=PHRASES).drop("detections")


QUERIES = {"op7_licenses": op7_licenses}
ORACLE_SQL: dict[str, str] = {}

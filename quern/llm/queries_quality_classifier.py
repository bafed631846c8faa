"""op3: the quality of all documents.

Documents have no address: their source stands for the host, and a language within a
source for a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .quality_classifier import classify


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.select(F.col("id").alias("doc_id"), "evidence", "host_posterior", "path_posterior", "score", "kept")


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE_SQL: dict[str, str] = {}

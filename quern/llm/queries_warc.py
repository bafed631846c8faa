"""op2: all pages to WARC archives and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import cut, drop_path, fresh_path, table
from .warc import archive


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "warc")
    try:
        return cut(archive(table(spark, sf_dir, "pages"), root))
    finally:
        drop_path(spark, root)


SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
k AS (SELECT digest, min(page_id) AS keeper FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
    CASE WHEN page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.digest = k.digest
"""

QUERIES = {"op2_warc": op2_warc}
ORACLE_SQL = {"op2_warc": SQL}

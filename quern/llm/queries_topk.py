"""op6: the nearest neighbours of one in a hundred vectors among all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .topk import top_k


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0, k=10)


SQL = """
WITH rows_of AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
each_x AS (
    SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS i, floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS x FROM rows_of
),
v AS (
    SELECT vec_id, embedding, list(x ORDER BY i) AS x FROM each_x GROUP BY vec_id, embedding
    HAVING count(*) = count(x) AND bool_and(isfinite(x))
),
scored AS (
    SELECT q.vec_id AS query_id, q.embedding AS e, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON len(q.x) = len(c.x) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS r, vec_id, score FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""

QUERIES = {"op6_topk": op6_topk}
ORACLE_SQL = {"op6_topk": SQL}

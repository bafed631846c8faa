"""op9: tokens of every whole document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .piece_count import count_tokens

MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def op9_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), model_path or public_tokenizers.path(MODEL), keys=["doc_id"], limit=LIMIT)


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE_SQL: dict[str, str] = {}

"""op4: every whole document through the byte-level BPE, and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import encode_texts
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op4_byte_bpe(spark: SparkSession, sf_dir: str, rank_path: str | None = None) -> DataFrame:
    return encode_texts(
        table(spark, sf_dir, "documents"),
        rank_path or public_tokenizers.path(RANKS),
        public_tokenizers.PATTERN,
        keys=["doc_id"],
        outputs=["n_tokens", "ids_sha256", "decoded_sha256"],
    )


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLE_SQL: dict[str, str] = {}

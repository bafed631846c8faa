"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but
the last return the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.byte_bpe import encode_texts
from quern.llm.common import drop_path, fresh_path, table
from quern.llm.line_dedup import dedup_lines
from quern.llm.mixing import mixed_rows
from quern.llm.near_dedup import keep_one
from quern.llm.quality_classifier import keep_good
from quern.llm.queries_byte_bpe import RANKS


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """``columns`` with another text, and the number of its characters where that is one."""
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return docs.select(*(own[c].alias(c) if c in own else F.col(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, fitted on the labels, rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share; documents stay, if with less text."""
    done = dedup_lines(docs)
    text = F.when(F.col("__n_dropped") > 0, F.col("__kept_text")).otherwise(F.col("text"))
    return _with_text(done, text, docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates.

    Near-duplicates' shingles of five words overlap by 0.8 or more; each link is compared exactly.
    Candidates come from fingerprints within 8 bits, by op10's grid join; the pairs that those
    miss are found by prefix filtering (README).
    """
    return keep_one(docs, width=5, least=(4, 5), max_bits=8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep, cut or drop documents as the mix of sources takes them."""
    mixed = mixed_rows(docs)
    return _with_text(mixed, F.col("text"), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the hash of what they decode to."""
    ranks = public_tokenizers.path(RANKS)
    return encode_texts(docs, ranks, public_tokenizers.PATTERN, keys=["doc_id", "source"], outputs=["n_tokens", "ids", "decoded_sha256"])


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("simhash", simhash), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: SQL can express neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each but the last is written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

"""All stages and operators on odd tables and very long texts."""

import corpus_pipeline as P
import pytest
from pyspark.sql import types as T

from quern.llm.registry import QUERIES

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
#: Columns of documents, and others named like columns that operators use.
EXTRA = ["id", "row", "size", "positions", "fingerprint", "component_id", "n_tokens", "ids", "kept", "score", "cell", "h1", "source_size", "host", "path"]
DOCS = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))]
    + [T.StructField(n, T.StringType()) for n in EXTRA]
)


def rows():
    good = "A sentence that many documents share, of over forty characters."
    out = [(i, f"{good}\nDocument {i} has words of its own, {i * 7} of them.", "en", f"s{i % 3}", 1) for i in range(12)]
    out += [(20, "JUNK!! " * 30, "en", "s0", 1), (21, None, "en", "s0", None), (22, "", None, None, 0), (23, " \n\t\n", "fr", None, 4), (None, good, "en", "s1", 1), (None, None, None, None, None)]
    out += [out[0], out[0], (1, "same id, other text, with some more words in it", "en", "s1", 1)]
    return [(*r, *(["x"] * len(EXTRA))) for r in out]


def write(spark, root, docs, labels):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{root}/embeddings.parquet")
    return str(root)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, tmp_path, empty):
    labels = [(i, 1, 0) for i in range(12)] + [(20, 0, 0), (None, 1, 0), (3, None, None)]
    root = write(spark, tmp_path / "in", [] if empty else rows(), [] if empty else labels)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in P.STAGES:
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts == [0] * 5 if empty else counts[0] >= counts[2] > 0 and counts[4] == counts[3] > 0
    if not empty:
        # texts without words go; repeated rows come through as one
        quality, simhash = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("quality", "simhash"))
        assert quality.where("doc_id IN (20, 21, 22, 23)").count() == 0
        assert simhash.where("doc_id = 0").count() <= 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_on_empty_and_odd_tables(spark, tmp_path, name):
    empty = write(spark, tmp_path / "empty", [], [])
    assert QUERIES[name](spark, empty).collect() == []
    if name not in ("op2_warc", "op6_topk"):
        odd = write(spark, tmp_path / "odd", rows(), [(1, 1, 0), (20, 0, 0)])
        assert QUERIES[name](spark, odd).count() == len(rows())


@pytest.mark.parametrize("name", ["op1_mixing", "op3_quality_classifier", "op4_byte_bpe", "op5_line_dedup", "op7_licenses", "op8_quality_rules", "op9_token_counts", "op10_simhash"])
def test_very_long_texts(spark, tmp_path, name):
    texts = ["word " * 400_000, "".join(f"line {i} of a text with many lines, all different\n" for i in range(40_000)), "x" * 2_000_000, "under the MIT license\n" * 20_000, "é" * 300_000 + " cc by nc"]
    root = write(spark, tmp_path / "long", [(i, t, "en", "s", None, *(["x"] * len(EXTRA))) for i, t in enumerate(texts)], [(0, 0, 0), (1, 1, 0)])
    got = {r.doc_id: r for r in QUERIES[name](spark, root).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    if name == "op7_licenses":
        assert got[3].n_base == 20_000 and got[3].last_word == 4 * 19_999 and got[4].first_word == 1
    if name == "op8_quality_rules":
        assert got[0].n_repeat_words == 400_000 and got[1].n_repeat_words == 359_999 and got[3].n_dup_lines == 19_999
    if name == "op5_line_dedup":
        assert got[1].n_lines == 40_001 and got[1].n_dropped == 0

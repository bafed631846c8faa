"""Operator 6 against brute force and its SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import topk
from quern.llm.queries_topk import ORACLE_SQL, op6_topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def brute(rows, k=10):
    rows = list({(d, *v): (d, [math.floor(1024 * float(np.float32(x))) for x in v]) for d, v in rows if d is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}.values())
    out = []
    for d, q in rows:
        if d % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != d and len(v) == len(q))[:k]
            out += [(d, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def rows():
    random.seed(5)
    out = []
    for i in range(700):
        v = [random.gauss(0, 0.3) for _ in range(8)] if i % 3 else [0.5, -0.5, 0.25, 0.0, 0.1, 0.0, 0.0, 0.0]
        out.append((i, [float(np.float32(x)) for x in v]))
    out += [(1000, [1.0, 2.0]), (1001, [1.0, -2.0]), (1100, []), (1101, []), (1200, None), (1300, [1.0, None] * 4), (1400, [float("nan")] * 8), (1500, [float("inf")] * 8)]
    out += [(1600, [0.0] * 8), (None, [1.0] * 8), out[100], out[7], (7, out[8][1]), (200, out[9][1]), (1700, [3.0])]
    # other vectors of one id that hash alike or are equal once turned into integers
    out += [(100, [0.5] * 7 + [-1.0 / 1024]), (100, [0.5] * 7 + [-2.0 / 1024]), (300, [0.25] * 8), (300, [0.25 + 1 / 4096] * 8), (301, [0.25] * 8), (301, [0.25 + 1 / 4096] * 8)]
    return out


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = sorted(map(tuple, op6_topk(spark, f"{tmp_path}/a").collect()))
    assert got == brute(rows())
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert op6_topk(spark, f"{tmp_path}/b").collect() == []


@pytest.mark.parametrize("k", [1, 3, 50])
def test_threshold_algorithm_stops_early_and_right(k):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-5, 6, (400, 5))
    ids = rng.permutation(400)
    block = topk.Block(ids, vectors)
    for q in rng.integers(-3, 4, (60, 5)):
        got = block.best(q, int(ids[0]), k)
        want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, vectors) if i != ids[0])[:k]
        assert list(zip((-got[1]).tolist(), got[0].tolist())) == want


def test_scores_beyond_a_long_fail(spark):
    df = spark.createDataFrame([(0, [1e17]), (1, [1e17])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(df, is_query=F.col("vec_id") == 0).collect()


def test_share_of_vectors_met():
    """The stop prunes where few dimensions have most of the spread, and not where all are alike."""
    rng = np.random.default_rng(8)
    met = []
    for spread in (np.r_[400, 200, np.full(6, 4)], np.full(64, 125)):
        block = topk.Block(np.arange(4000), rng.normal(0, spread, (4000, len(spread))).astype(np.int64))
        for q in rng.normal(0, spread, (20, len(spread))).astype(np.int64):
            block.best(q, -1, 10)
        met.append(block.met / (block.asked * 4000))
    assert met[0] < 0.5 and met[1] > 0.9, met


def test_huge_components():
    m = topk.quantised([[1e30, 1.0], [-1e30, 2.0]], 1024.0)
    assert m.dtype == object
    block = topk.Block(np.array([1, 2]), m)
    ids, scores = block.best(m[0], 9, 2)
    assert ids.tolist() == [1, 2] and scores[0] == m[0][0] ** 2 + 1024**2


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, op6_topk(spark, sf).collect())) == sorted(con.execute(ORACLE_SQL["op6_topk"]).fetchall())

"""Operator 5 against brute force, and its runs."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from quern.llm import common
from quern.llm.common import UPPER, LOWER, WS_CHARS
from quern.llm import line_dedup
from quern.llm.line_dedup import LineRuns, dedup_lines, sorted_scans
from quern.llm.queries_line_dedup import op5_line_dedup

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("positions", T.StringType()), ("__id", T.LongType()))][:3])


def brute(rows):
    key = lambda x: x.strip(WS_CHARS).translate(str.maketrans(UPPER, LOWER))
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            docs[key(x)].add(d)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in docs.items() if len(k) >= 40 and len(v) >= 5}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or (keeper[key(x)] == d and d is not None)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    random.seed(4)
    common = [f"This LINE number {i} is shared by many documents é" for i in range(12)] + ["short", "", "   ", "x" * 39, "y" * 40]
    out = []
    for d in range(60):
        lines = [random.choice(common) if random.random() < 0.6 else f"own line {d} {random.random()}" for _ in range(random.randint(0, 12))]
        lines = [(" \t" * random.randint(0, 2)) + (x.upper().replace("É", "é") if random.random() < 0.3 else x) + "\r" * random.randint(0, 1) for x in lines]
        out.append((d, "\n".join(lines)))
    out += [(7, out[7][1]), (7, common[0]), (None, common[0] + "\n" + common[1]), (None, common[0]), (100, None), (101, ""), (102, "\n\n")]
    return out


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 7, "fanout": 3}])
@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, tmp_path, options, small, monkeypatch):
    if not small:  # most keys are shuffled, and all texts
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(line_dedup, "join_keys", lambda *a, **b: common.join_keys(*a, **b, most=3))
    df = spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA).repartition(3)
    got = dedup_lines(df, **options)
    assert got.columns[:3] == df.columns
    have = [(r.doc_id, r["__n_lines"], r["__n_dropped"], hashlib.sha256(r["__kept_text"].encode()).hexdigest()) for r in got.collect()]
    assert sorted(have, key=str) == brute(rows())


def test_query(spark, tmp_path):
    spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert sorted(map(tuple, op5_line_dedup(spark, f"{tmp_path}/a").collect()), key=str) == brute(rows())
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op5_line_dedup(spark, f"{tmp_path}/b").collect() == []


def test_runs_count_and_keep(spark):
    runs = LineRuns(spark, fanout=2)
    with sorted_scans(spark):
        check_runs(spark, runs)


def check_runs(spark, runs):
    try:
        for ids in ([9, 8], [7], [6, 5], [4], [3]):
            runs.add(spark.createDataFrame([(1, 1, i) for i in ids] + [(2, ids[0], ids[0])], "h1 long, h2 long, id long"))
        assert [len(x) for x in runs.levels] == [1, 0, 1]
        got = {(r.h1, r.h2): (r.n_docs, r.keeper) for r in runs.merged().collect()}
        assert got == {(1, 1): (7, 9)} | {(2, i): (1, i) for i in (9, 7, 6, 4, 3)}
        plan = runs.merged()._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        first, *rest = runs.runs()
        plan = spark.table(first).hint("merge").join(spark.table(rest[0]), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    finally:
        runs.close()

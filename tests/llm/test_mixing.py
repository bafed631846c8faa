"""Operator 1 against brute force and its bounds."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.mixing import mix, mixed_rows, sainte_lague
from quern.llm.queries_mixing import op1_mixing


def highest_quotients(votes, seats):
    got = Counter()
    for _ in range(seats):
        got[min(range(len(votes)), key=lambda i: (-votes[i] / (got[i] + 0.5), i))] += 1
    return [got[i] for i in range(len(votes))]


def test_sainte_lague(spark):
    random.seed(1)
    cases = [([5.0, 2.0, 1.0], 8), ([1.0], 7), ([3.0, 3.0, 3.0], 4), ([0.0, 1.0], 3), ([1e6, 1.0, 1.0, 2.0], 1000), ([1.0] * 30 + [900.0], 200), ([2.0, 1.0], 0)]
    cases += [([random.choice([1, 10, 100, 1000]) * random.random() for _ in range(random.randint(1, 40))], random.randint(0, 500)) for _ in range(60)]
    rows = [(i, [(k, v) for k, v in enumerate(votes)], seats) for i, (votes, seats) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, p array<struct<id:long,votes:double>>, n long")
    for r in df.select("i", sainte_lague(F.col("p"), F.col("n")).alias("s")).collect():
        assert r.s == highest_quotients(*cases[r.i]), cases[r.i]


def plain_targets(sizes):
    """By resharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    pool, done = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in done]
        level = (pool - sum(done.values())) / max(1e-300, sum(w[s] for s in free)) if free else 0
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return done | {s: level * w[s] for s in free}
        done |= {s: 2.0 * sizes[s] for s in over}


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("row", T.StringType())])


def docs():
    random.seed(8)
    names = ["b", "a", "é", "Z", None, "hot", "tiny", "empty"]
    out = []
    for i in range(900):
        s = random.choice(names[:5]) if random.random() < 0.6 else "hot"
        out.append((i, " ".join("w" * random.randint(1, 3) for _ in range(random.choice([3, 40, 200]))) + "\n", s, "x", None))
    out += [(900, "one two", "tiny", "x", None), (901, None, "empty", "x", None), (902, "", "empty", "x", None), (None, "a b c " * 30, "a", None, None)]
    return out + [out[5]] * 3 + [out[-1]]


def test_small_sources_come_near_their_targets(spark):
    """A tail of sources of a few words beside large ones: none vanishes, none is doubled."""
    sizes = {f"s{k:03}": n for k, n in enumerate([1, 2, 5, 10, 20, 33, 45, 63, 64, 100] * 6 + [50_000, 20_000])}
    df = spark.createDataFrame([(i * 1000 + j, " ".join(["w"] * min(50, n - 50 * j)), s) for i, (s, n) in enumerate(sizes.items()) for j in range(-(-n // 50))], "doc_id long, text string, source string")
    taken = {r.source: r for r in mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    want = plain_targets(sizes)
    for s, r in taken.items():
        assert abs(r.target - want[s]) < 1e-6 and abs(r.taken - r.target) <= max(1, 0.02 * r.target), (s, r)


def check(rows, got):
    sizes, taken = defaultdict(int), defaultdict(int)
    by_id = {(r[0], r[1]): r[2] for r in rows}
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want = plain_targets(dict(sizes))
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").split())) for r in rows)
    assert by_id
    return want, taken


def test_query(spark, tmp_path):
    spark.createDataFrame(docs(), SCHEMA).repartition(4).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = op1_mixing(spark, f"{tmp_path}/a").collect()
    want, taken = check(docs(), got)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(64, 0.02 * t), (s, t, taken[s])
    again = op1_mixing(spark, f"{tmp_path}/a").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op1_mixing(spark, f"{tmp_path}/b").collect() == []
    spark.createDataFrame([r for r in docs() if r[2] == "empty"], SCHEMA).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert [tuple(r)[1:] for r in op1_mixing(spark, f"{tmp_path}/c").collect()] == [(0, 0, 0.0, 0)] * 2


def test_rows_of_the_mix(spark):
    df = spark.createDataFrame(docs(), SCHEMA)
    plan = mix(df).collect()
    rows = mixed_rows(df)
    assert rows.columns == df.columns
    words, known = Counter(), defaultdict(set)
    for d in docs():
        known[d[0]].add(d[1])
    for r in rows.collect():
        words[r.doc_id] += len(r.text.split())
        assert any(" ".join(r.text.split()) in " ".join((t or "").split()) for t in known[r.doc_id])
    want = Counter()
    for r in plan:
        want[r.id] += r.taken
    assert +words == +want


def test_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source, None, None) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    want, taken = check(rows, op1_mixing(spark, sf).collect())
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(64, 0.02 * t), (s, t, taken[s])

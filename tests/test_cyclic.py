"""Cyclic joins in SQL: what is found, and that results stay those of plain joins."""

import random

import pytest

from quern import cyclic
from quern.engine import Engine


@pytest.fixture(scope="module")
def edges(spark):
    """Views e0 .. e2 (a, b, w) with nulls, repeated rows and a hot key, and the small table n."""
    rng = random.Random(5)
    for k in range(3):
        rows = [(rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.choice([None, 1, 1, 1, 2, 3, 5]), rng.random()) for _ in range(25)]
        spark.createDataFrame(rows, "a int, b long, w double").createOrReplaceTempView(f"e{k}")
    spark.createDataFrame([(1, "one"), (2, "two"), (2, "zwei")], "id int, name string").createOrReplaceTempView("n")
    yield
    for name in ("e0", "e1", "e2", "n"):
        spark.catalog.dropTempView(name)
    spark.conf.unset("spark.quern.multiway")


TRIANGLE = "x.b = y.a AND y.b = z.a AND z.b = x.a"
ROUTED = {
    "count": f"SELECT count(*) AS n FROM e0 x, e1 y, e2 z WHERE {TRIANGLE}",
    "count_of_none": f"SELECT count(*) AS n FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} AND x.a > 100",
    "grouped": f"SELECT x.a, min(y.b) AS low, count(*) FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} GROUP BY x.a HAVING count(*) > 2 ORDER BY count(*) DESC, x.a LIMIT 3",
    "grouped_without_counts": f"SELECT x.a, y.a AS c FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} GROUP BY x.a, y.a",
    "copies": f"SELECT x.a, x.b, z.a AS c FROM e0 x, e1 y, e2 z WHERE {TRIANGLE}",
    "distinct": f"SELECT DISTINCT x.a, x.b FROM e0 x, e1 y, e2 z WHERE {TRIANGLE}",
    "sums": f"SELECT x.a, round(sum(y.w + z.w), 6) AS s, count(x.a) AS n FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} GROUP BY x.a",
    "sum_of_keys": f"SELECT sum(x.a) AS s, count(*) AS n FROM e0 x, e1 y, e2 z WHERE {TRIANGLE}",
    "filters": f"SELECT x.a, count(*) AS n FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} AND x.w > 0.3 AND y.b BETWEEN 1 AND 3 AND (z.w < 0.9 OR z.a = 1) GROUP BY x.a",
    "residual": f"SELECT x.a, y.w FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} AND x.w < y.w AND x.a <= z.a",
    "ear": f"SELECT name, count(*) AS n FROM e0 x, e1 y, e2 z, n WHERE {TRIANGLE} AND id = x.a GROUP BY name",
    "on": "SELECT count(*) AS n FROM e0 x JOIN e1 y ON x.b = y.a INNER JOIN e2 AS z ON y.b = z.a AND z.b = x.a",
    "derived": "WITH s AS (SELECT DISTINCT a, b FROM e1) SELECT p, count(*) AS n FROM (SELECT a AS p, b AS q FROM e0) x, s, (SELECT a AS u, b AS v FROM e2 WHERE w > 0.1) z WHERE q = s.a AND s.b = u AND v = p GROUP BY p",
    "unqualified": "SELECT p, q FROM (SELECT a AS p, b AS q FROM e0) x, (SELECT a AS r, b AS s FROM e1) y, (SELECT a AS u, b AS v FROM e2) z WHERE q = r AND s = u AND v = p ORDER BY p, q",
    "comments": f"SELECT count(*) AS n -- all\nFROM e0 x, e1 y, e2 z /* three */ WHERE {TRIANGLE} AND x.w > 0.2 -- large",
    "four": "SELECT count(*) AS n FROM e0 w, e1 x, e2 y, e0 z WHERE w.b = x.a AND x.b = y.a AND y.b = z.a AND z.b = w.a",
}
PLAIN = {
    "acyclic": "SELECT count(*) AS n FROM e0 x, e1 y, e2 z WHERE x.b = y.a AND y.b = z.a AND x.w < z.w",
    "star": "SELECT count(*) AS n FROM e0 x, e1 y, e2 z WHERE x.a = y.a AND y.a = z.a AND z.a = x.a",
    "outer": "SELECT count(*) AS n FROM e0 x LEFT JOIN e1 y ON x.b = y.a JOIN e2 z ON y.b = z.a AND z.b = x.a",
    "either": f"SELECT count(*) AS n FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} OR x.a = 1",
    "doubles": "SELECT count(*) AS n FROM e0 x, e1 y, e2 z WHERE x.b = y.a AND y.b = z.a AND z.w = x.w",
    "columns": f"SELECT * FROM e0 x, e1 y, e2 z WHERE {TRIANGLE}",
    "sub_query": f"SELECT count(*) AS n FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} AND x.a IN (SELECT id FROM n)",
    "random": f"SELECT count(*) AS n FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} AND x.w > rand() - 1",
    "union": f"SELECT x.a FROM e0 x, e1 y, e2 z WHERE {TRIANGLE} UNION SELECT id FROM n",
}


# a column called like a table whose keys alone are used: left to Spark
PLAIN["named_like_tables"] = f"SELECT round(sum(x), 6) AS n FROM e0 x, e1 y, (SELECT a, b, w AS x FROM e2) z WHERE {TRIANGLE}"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(ROUTED | PLAIN))
def test_same_rows(spark, edges, name):
    sql = (ROUTED | PLAIN)[name]
    spark.conf.set("spark.quern.multiway", "never")
    want = Engine(spark).query(sql)
    spark.conf.set("spark.quern.multiway", "always")
    got = Engine(spark).query(sql)
    assert ("MapInArrow" in plan(got)) == (name in ROUTED) and "MapInArrow" not in plan(want)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_copies_by_the_thousand(spark, edges, monkeypatch):
    monkeypatch.setattr(cyclic, "_COPIES", 7)
    sql = ROUTED["copies"]
    spark.conf.set("spark.quern.multiway", "never")
    want = Engine(spark).query(sql).collect()
    spark.conf.set("spark.quern.multiway", "always")
    assert sorted(map(tuple, Engine(spark).query(sql).collect())) == sorted(map(tuple, want))


def test_only_joins_that_blow_up(spark):
    """By themselves: a hot triangle goes to the multi-way join, one of keys does not."""
    spark.conf.unset("spark.quern.multiway")
    hot = spark.range(3000).selectExpr("id % 30 AS a", "id DIV 30 AS b")
    hot.union(hot.selectExpr("b", "a")).createOrReplaceTempView("hot")
    spark.range(3000).selectExpr("id AS a", "id AS b").createOrReplaceTempView("keys")
    spark.createDataFrame([], "a long, b long").createOrReplaceTempView("nothing")
    sql = "SELECT count(*) AS n FROM {0} x, {0} y, {0} z WHERE " + TRIANGLE
    routed = {t: "MapInArrow" in plan(Engine(spark).query(sql.format(t))) for t in ("hot", "keys", "nothing")}
    assert routed == {"hot": True, "keys": False, "nothing": False}
    for name in routed:
        spark.catalog.dropTempView(name)


def test_sketches_leave_no_shuffles(spark, edges):
    """Shuffles of sub-queries that a sketch reads are gone when it is done."""
    import glob

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    kept = lambda: {f for d in root for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before = kept()
    df = spark.sql("SELECT DISTINCT a AS v0, b AS v1 FROM e0").dropna()
    rows, _ = cyclic._sketches({"x": df}, {"x": [(0,)]})
    assert rows["x"] > 0
    assert not kept() - before
    assert spark.conf.get(cyclic._CLEANUP) == "false"

"""Joins that make many more rows than they read: the rows of plain joins, over many tasks."""

import pytest

from quern import heavy
from quern.engine import Engine


@pytest.fixture
def hot(spark, monkeypatch):
    monkeypatch.setattr(heavy, "TASK_PAIRS", 500)
    rows = [(k, float(k % 3) if k % 7 else None, k % 5) for k in range(120)] + [(200, -0.0, 1), (201, float("nan"), 1), (202, float("nan"), 2)]
    spark.createDataFrame(rows, "id long, price double, g int").createOrReplaceTempView("hot_pairs")
    yield
    spark.catalog.dropTempView("hot_pairs")
    spark.conf.unset("spark.quern.multiway")


DEALT = [
    "SELECT a.id AS p, b.id AS q FROM hot_pairs a, hot_pairs b WHERE a.price = b.price AND a.id < b.id",
    "SELECT a.g, count(*) AS n FROM hot_pairs a JOIN hot_pairs b ON a.price = b.price AND a.g <= b.g WHERE a.id <> 5 AND b.id > 3 GROUP BY a.g ORDER BY a.g",
    "WITH w AS (SELECT id, g FROM hot_pairs WHERE id > 2) SELECT a.id AS p, b.id AS q FROM w a, hot_pairs b WHERE a.g = b.g",
]
PLAIN = ["SELECT a.id AS p, b.id AS q FROM hot_pairs a, hot_pairs b WHERE a.id = b.id", "SELECT a.id AS p, b.id AS q FROM hot_pairs a LEFT JOIN hot_pairs b ON a.g = b.g", "SELECT * FROM hot_pairs a, hot_pairs b WHERE a.g = b.g"]


@pytest.mark.parametrize("sql", DEALT + PLAIN)
def test_same_rows_over_many_tasks(spark, hot, sql):
    spark.conf.set("spark.quern.multiway", "never")
    want = sorted(str(tuple(r)) for r in Engine(spark).query(sql).collect())
    spark.conf.unset("spark.quern.multiway")
    got = Engine(spark).query(sql)
    assert ("__salt" in got._jdf.queryExecution().optimizedPlan().toString()) == (sql in DEALT)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    if sql == DEALT[0]:
        assert got.rdd.getNumPartitions() > 4

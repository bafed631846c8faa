"""The SQL front end, and the decisions on semantics it rests on."""

import datetime

import pytest
from pyspark.sql import functions as F

from quern import dialect as D


def nulls(sql):
    return D.text(D.null_order(D.tokens(sql)))


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY a NULLS LAST"),
        ("SELECT a FROM t ORDER BY a DESC, b ASC LIMIT 3", "SELECT a FROM t ORDER BY a DESC NULLS FIRST, b ASC NULLS LAST LIMIT 3"),
        ("SELECT a FROM t ORDER BY f(a, b), c NULLS FIRST", "SELECT a FROM t ORDER BY f(a, b) NULLS LAST, c NULLS FIRST"),
        ("SELECT * FROM (SELECT a FROM t ORDER BY a DESC) x ORDER BY (a + 1)", "SELECT * FROM (SELECT a FROM t ORDER BY a DESC NULLS FIRST) x ORDER BY (a + 1) NULLS LAST"),
        ("SELECT sum(a) OVER (ORDER BY b ROWS 1 PRECEDING) FROM t", "SELECT sum(a) OVER (ORDER BY b NULLS LAST ROWS 1 PRECEDING) FROM t"),
        ("SELECT 'ORDER BY a' FROM t -- ORDER BY b", "SELECT 'ORDER BY a' FROM t -- ORDER BY b"),
    ],
)
def test_null_order(sql, want):
    assert nulls(sql) == want


def test_plain_literals():
    made = lambda s: D.text(D.plain_literals(D.tokens(s)))
    assert made("1.5 + 2 + .5 + 1e3 + 2.0D + t.c") == "1.5D + 2 + .5D + 1e3 + 2.0D + t.c"
    assert made('"My Col" = \'1.5\'') == "`My Col` = '1.5'"
    assert made("TIMESTAMP '1999-01-01 00:00:00'") == "TIMESTAMP_NTZ '1999-01-01 00:00:00'"
    assert made("{d '1999-01-01'}").split() == ["DATE", "'1999-01-01'"]


def test_split_script():
    assert D.split_script("SELECT ';' ; -- a;b\n SELECT 2;;") == ["SELECT ';'", "-- a;b\n SELECT 2"]


def test_integer_division(spark):
    spark.createDataFrame([(7, 2, 2.0), (-7, 2, 2.0), (7, -2, 4.0), (6, 3, 3.0)], "a int, b int, x double").createOrReplaceTempView("ints")
    run = lambda s: [tuple(r) for r in spark.sql(D.to_spark(spark, s)).collect()]
    assert run("SELECT a / b, a % b, a / x, a / b / 2, -a FROM ints") == [(3, 1, 3.5, 1, -7), (-3, -1, -3.5, -1, 7), (-3, 1, 1.75, -1, -7), (2, 0, 2.0, 1, -6)]
    assert run("SELECT a & 3, a | 8, a ^ 1 FROM ints WHERE a > 6") == [(3, 15, 6), (3, 15, 6)]


def test_where_aliases(spark):
    spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "a int, b int").createOrReplaceTempView("pairs")
    run = lambda s: [tuple(r) for r in spark.sql(D.to_spark(spark, s)).collect()]
    assert run("SELECT a + b AS s, a FROM pairs WHERE s > 11 AND s < 33") == [(22, 2)]
    # an input column wins over an alias of its name
    assert run("SELECT b AS a FROM pairs WHERE a = 2") == [(20,)]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        run("SELECT a FROM pairs WHERE nothing = 1")


def test_three_valued_logic_and_nulls(spark):
    rows = [(1, 2.0, "a", datetime.date(2020, 1, 31)), (None, 3.0, None, datetime.date(2020, 2, 29)), (3, None, "c", None), (0, 0.0, "", datetime.date(1999, 12, 31))]
    spark.createDataFrame(rows, "k int, v double, s string, d date").createOrReplaceTempView("nulls")
    one = lambda s: [r[0] for r in spark.sql(D.to_spark(spark, s)).collect()]
    assert one("SELECT k FROM nulls ORDER BY k") == [0, 1, 3, None]
    assert one("SELECT k FROM nulls ORDER BY k DESC") == [None, 3, 1, 0]
    assert one("SELECT k FROM nulls WHERE NOT (v > 1.0)") == [0]
    assert sorted(one("SELECT count(*) FROM nulls GROUP BY k")) == [1, 1, 1, 1]
    assert one("SELECT a.k FROM nulls a, nulls b WHERE a.k = b.k ORDER BY a.k") == [0, 1, 3]
    assert one("SELECT k FROM nulls WHERE 5 NOT IN (SELECT k FROM nulls)") == []
    assert one("SELECT k FROM nulls WHERE NULL IS NULL AND k = 1") == [1]
    assert one("SELECT d + INTERVAL '1' MONTH FROM nulls WHERE d IS NOT NULL ORDER BY d DESC") == [datetime.date(2020, 3, 29), datetime.date(2020, 2, 29), datetime.date(2000, 1, 31)]
    assert one("SELECT sum(k) FROM nulls WHERE k > 5") == [None]
    assert one("SELECT count(k) FROM nulls WHERE k > 5") == [0]
    assert one("SELECT avg(k) FROM nulls WHERE k < 2") == [0.5]


def test_like(spark):
    spark.createDataFrame([("abc",), ("a_c",), ("a?c",), ("a%c",), ("",), (None,)], "s string").createOrReplaceTempView("likes")
    run = lambda p: {r[0] for r in spark.sql(D.to_spark(spark, f"SELECT s FROM likes WHERE s {p}")).collect()}
    assert run("LIKE 'a_c'") == {"abc", "a_c", "a?c", "a%c"}
    assert run("LIKE 'a?c'") == {"a?c"}
    assert run("NOT LIKE 'a%'") == {""}


def test_subqueries(spark):
    spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (3, 2, 1.0)], "id int, cust int, price double").createOrReplaceTempView("o")
    spark.createDataFrame([(1,), (2,), (3,)], "cust int").createOrReplaceTempView("c")
    one = lambda s: [r[0] for r in spark.sql(D.to_spark(spark, s)).collect()]
    assert one("SELECT cust FROM c WHERE 0 = (SELECT count(*) FROM o WHERE o.cust = c.cust)") == [3]
    assert one("SELECT cust FROM c WHERE EXISTS (SELECT 1 FROM o WHERE o.price > 6) ORDER BY cust") == [1, 2, 3]
    assert one("SELECT (SELECT max(price) FROM o WHERE o.cust = c.cust) AS m FROM c ORDER BY m") == [1.0, 7.0, None]


def test_plans_push_down_and_prune(spark):
    from quern.plans import catalogue

    plan = catalogue.QUERIES["tpch_q6"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_comment" not in read and read.count(":") == 4
    topk = catalogue.QUERIES["topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in topk
    factored = catalogue.QUERIES["or_factoring"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" in factored or "SortMergeJoin" in factored


@pytest.mark.parametrize(
    "sql,kind,name",
    [
        ("create table T (a int primary key, b varchar(10) not null, c numeric, unique (c))", "create_table", "t"),
        ("CREATE VIEW v(x, y) AS SELECT a, b FROM t", "create_view", "v"),
        ("DROP TABLE t", "drop", "t"),
        ("SELECT a INTO u FROM t WHERE a > 1", "select", "u"),
        ("SELECT a FROM t", "select", None),
        ("INSERT INTO t VALUES (1)", "other", None),
    ],
)
def test_parse(sql, kind, name):
    s = D.parse(sql)
    assert (s.kind, s.name) == (kind, name)
    if kind == "create_table":
        assert s.specs == [("a", "int", {"primary"}), ("b", "varchar(10)", {"not_null"}), ("c", "numeric", {"unique"})]
    if name == "u":
        assert s.sql.split() == "SELECT a FROM t WHERE a > 1".split()


def test_functions(spark):
    from quern.functions import int_divide, register_functions

    register_functions(spark)
    assert spark.sql("SELECT int_equals(1, 1), int_equals(1, 2), int_equals(1, NULL)").first() == (1, 0, None)
    assert spark.range(1).select(int_divide("-7", "2"), F.lit(1)).first()[0] == -3


def test_user_defined_aggregates_and_table_functions(spark):
    from quern.functions import register_aggregate, register_table_function

    register_aggregate(spark, "spread", lambda x: float(x.max() - x.min()), "double")
    got = spark.sql("SELECT id % 2 AS k, spread(id) AS s FROM range(10) GROUP BY id % 2 ORDER BY k").collect()
    assert [tuple(r) for r in got] == [(0, 8.0), (1, 8.0)]
    register_table_function(spark, "twice", lambda n: [(n, k) for k in range(2)], "n bigint, k int")
    assert [tuple(r) for r in spark.sql("SELECT t.* FROM range(2) r, LATERAL twice(r.id) t ORDER BY 1, 2").collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_table_names_are_used_once():
    for good in ("t, u", "t a, t b", "t CROSS JOIN u", "t a LEFT JOIN t b ON a.k = b.k AND f(a.k, b.k) JOIN u USING (k)", "(SELECT 1 FROM t) x, t", "d.t, (SELECT 1 FROM t, u) AS v"):
        D.check_tables(f"SELECT 1 FROM {good} WHERE 1 = 1")
    D.check_tables("SELECT 1 FROM t UNION SELECT 2 FROM t")
    for bad in ("t, t", "t a, u AS A", "t JOIN t ON 1 = 1", "t CROSS JOIN u LEFT JOIN t ON 1 = 1", "(SELECT 1) x, t x", "t x, (SELECT 1 FROM u) x"):
        with pytest.raises(ValueError, match="more than once"):
            D.check_tables(f"SELECT 1 FROM {bad} WHERE 1 = 1")


@pytest.mark.parametrize("inner", ["SELECT b FROM nin_b WHERE b > 1", "SELECT b FROM nin_b", "SELECT b FROM nin_b WHERE b > 100", "SELECT b FROM nin_b WHERE b IS NULL"])
@pytest.mark.parametrize(
    "outer",
    [
        "SELECT a, c FROM nin_a WHERE a NOT IN ({0})",
        "SELECT a, c FROM nin_a x WHERE c BETWEEN 1 AND 9 AND NOT x.a IN ({0}) AND c < 4 ORDER BY c",
        "SELECT a, c FROM nin_a WHERE a + 1 NOT IN ({0}) AND c NOT IN ({0})",
        "SELECT a, c FROM (SELECT * FROM nin_a WHERE a NOT IN ({0})) t WHERE c > 0",
        "WITH w AS ({0}) SELECT a, c FROM nin_a WHERE a NOT IN (SELECT * FROM w)",
    ],
)
def test_not_in_joins_by_its_key(spark, inner, outer):
    """The rows of Spark's own NOT IN, by a join that doesn't broadcast a side because of nulls."""
    spark.createDataFrame([(None, 1), (1, 2), (2, 3), (5, 4)], "a int, c int").createOrReplaceTempView("nin_a")
    spark.createDataFrame([(None,), (2,), (2,), (6,)], "b long").createOrReplaceTempView("nin_b")
    sql = outer.format(inner)
    made = spark.sql(D.to_spark(spark, sql))
    shown = made._jdf.queryExecution().optimizedPlan().toString()
    assert " OR isnull((" not in shown
    assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, spark.sql(sql).collect()), key=str)


@pytest.mark.parametrize("where", ["c = 1 OR a NOT IN (SELECT b FROM nin_b)", "NOT (c = 1 AND a NOT IN (SELECT b FROM nin_b))", "a NOT IN (SELECT b FROM nin_b LIMIT 1)", "abs(a) NOT IN (SELECT b FROM nin_b)", "a NOT IN (1, 2)"])
def test_not_in_left_to_spark(spark, where):
    spark.createDataFrame([(None, 1), (1, 2)], "a int, c int").createOrReplaceTempView("nin_a")
    spark.createDataFrame([(2,), (6,)], "b long").createOrReplaceTempView("nin_b")
    sql = f"SELECT a FROM nin_a WHERE {where}"
    assert D.to_spark(spark, sql) == sql


def test_not_in_of_each_row(spark):
    """A query that refers to the row outside it."""
    spark.createDataFrame([(None, 1), (1, 2), (2, 3), (5, 4), (6, 9)], "a int, c int").createOrReplaceTempView("nin_a")
    spark.createDataFrame([(None, 1), (1, 2), (7, 3), (None, 4)], "b long, d int").createOrReplaceTempView("nin_b")
    sql = "SELECT a, c FROM nin_a WHERE a NOT IN (SELECT b FROM nin_b WHERE d = c)"
    assert sorted(map(tuple, spark.sql(D.to_spark(spark, sql)).collect())) == [(2, 3), (6, 9)]

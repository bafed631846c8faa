"""Catalog, CSV, console, server and streaming loads."""

import datetime
import json
import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest
from pyspark.sql import types as T

from quern.catalog import CatalogError, Database
from quern.console import Console
from quern.engine import Engine
from quern.printing import iso_duration, lines, months
from quern.server import serve
from quern.sources import read_csv, write_csv
from quern.streaming import follow_csv
from quern.types import spark_type


@pytest.fixture
def engine(spark, request):
    name = f"db_{abs(hash(request.node.name)) % 10**8}"
    yield Engine(spark, name)
    spark.catalog.setCurrentDatabase("default")
    spark.sql(f"DROP DATABASE {name} CASCADE")


DDL = "CREATE TABLE t (a int primary key, b varchar(10) not null, c numeric, d date)"


def test_types():
    assert spark_type("NUMERIC") == T.DoubleType() and spark_type("character  varying(3)") == T.StringType()
    with pytest.raises(ValueError):
        spark_type("blob")


def test_ddl(engine):
    assert engine.execute(DDL) is None
    db = engine.database
    assert db.tables() == ["t"] and [f.dataType.simpleString() for f in db.schema("T")] == ["int", "string", "double", "date"]
    assert db.schema("t")["a"].metadata == {"keys": ["primary"]}
    for bad in (DDL, "CREATE TABLE u (a blob)", "CREATE TABLE u (a int, A int)", "DROP TABLE nothing", "INSERT INTO t VALUES (1)"):
        with pytest.raises(CatalogError):
            engine.execute(bad)
    db.copy_table("t", "u")
    assert db.schema("u") == db.schema("t")
    engine.execute("DROP t")
    assert db.tables() == ["u"]


@pytest.mark.parametrize(
    "items,names",
    [
        ("a, a, t.a", ["a", "a2", "a3"]),
        ("count(*), sum(a), sum(c), count(b) AS n", ["count", "sum", "sum2", "n"]),
        ("1, 2 + 3, 'x'", ["default", "default2", "default3"]),
        ("DISTINCT b", ["b"]),
        ("a + 1 x, c AS y, (a) * (2)", ["x", "y", "default"]),
        ("CASE WHEN a > 1 THEN 2 ELSE 3 END, max(a) OVER (PARTITION BY b)", ["default", "default2"]),
        ("c AS a, a", ["a", "a2"]),
        ("*, a AS z", ["a", "b", "c", "d", "z"]),
        ("1 AS q UNION SELECT 2", ["q"]),
    ],
)
def test_column_names(engine, items, names):
    engine.execute(DDL)
    assert engine.query(f"SELECT {items} FROM t").columns == names
    for bad in ("a AS x, c AS X", "a, c AS a", "*, a AS x, b AS x"):
        with pytest.raises(ValueError, match="more than once"):
            engine.query(f"SELECT {bad} FROM t")


def test_columns_of_one_name_can_be_stored(engine):
    engine.execute(DDL)
    engine.execute("SELECT a, a, count(*) INTO u FROM t GROUP BY a")
    assert engine.database.schema("u").names == ["a", "a2", "count"]


def test_csv(engine, spark, tmp_path):
    engine.execute(DDL)
    (tmp_path / "a.csv").write_text('1|x|1.5|2020-01-31\n2||NULL|\n3|"a|b"|-2|NULL\n4|""|0|1999-12-31\n')
    engine.database.load_csv("t", str(tmp_path / "a.csv"), "|", "NULL")
    rows = [tuple(r) for r in engine.query("SELECT * FROM t ORDER BY a").collect()]
    assert rows == [(1, "x", 1.5, datetime.date(2020, 1, 31)), (2, None, None, None), (3, "a|b", -2.0, None), (4, None, 0.0, datetime.date(1999, 12, 31))]
    write_csv(engine.query("SELECT * FROM t"), str(tmp_path / "out"), separator=";", null="-")
    again = read_csv(spark, str(tmp_path / "out"), engine.database.schema("t"), separator=";", null="-")
    assert sorted(map(tuple, again.collect())) == rows
    (tmp_path / "bad.csv").write_text("x|y|z|w\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        read_csv(spark, str(tmp_path / "bad.csv"), engine.database.schema("t"), separator="|").collect()
    with pytest.raises(ValueError):
        read_csv(spark, "x", engine.database.schema("t"), separator="||")


def test_time_column(engine, spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,10:11:12\n2,\n")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", T.TimeType(0))])
    assert [r.t for r in read_csv(spark, str(tmp_path / "t.csv"), schema).orderBy("k").collect()] == [datetime.time(10, 11, 12), None]


def test_views_are_snapshots(engine):
    engine.execute(DDL)
    engine.execute("CREATE VIEW v(n) AS SELECT count(*) FROM t")
    engine.spark.sql("INSERT INTO t VALUES (1, 'x', 1.0, NULL)")
    assert engine.query("SELECT n FROM v").first()[0] == 0
    engine.execute("SELECT a, b INTO w FROM t")
    assert engine.query("SELECT * FROM w").collect() == [(1, "x")]
    with pytest.raises(CatalogError):
        engine.execute("CREATE VIEW v2(n, m) AS SELECT a FROM t")


def test_export_and_analyze(engine, tmp_path):
    engine.execute(DDL)
    engine.spark.sql(f"INSERT INTO {engine.database.name}.t VALUES (1, 'x', 1.0, NULL), (2, 'y', 1.0, NULL)")
    engine.database.export("t", str(tmp_path / "first"), rows=1)
    assert engine.spark.read.parquet(str(tmp_path / "first")).count() == 1
    assert engine.database.analyze() == ["t"] and engine.database.analyze(keys_only=True) == ["t"]


def test_script_goes_on(engine):
    done = engine.script("SELECT 1 AS a; SELECT nothing FROM nowhere; SELECT 7 / 2 AS b")
    assert done[0][1].first()[0] == 1 and isinstance(done[1][1], Exception) and done[2][1].first()[0] == 3


def test_console(engine, tmp_path):
    out = []
    console = Console(engine, out.append)
    (tmp_path / "a.csv").write_text("1,x,1.5,2020-01-31\n2,,,\n")
    (tmp_path / "s.sql").write_text("SELECT a FROM t WHERE a = 1; SELECT b FROM t WHERE a = 2;")
    for line in (DDL + ";", f"load t {tmp_path}/a.csv , NULL", "SELECT a, b FROM t ORDER BY a;", f"exec {tmp_path}/s.sql", "list", "nonsense", "", "index all", "compress", "help", f"explain {tmp_path} 5 1 SELECT a FROM t", "explain SELECT a FROM t"):
        assert console.run(line)
    assert out[:3] == ["a\tb", "1\tx", "2\t[null]"] and out[3:7] == ["a", "1", "b", "[null]"]
    assert out[7].startswith("t(a int") and out[8].startswith("Error") and "Physical Plan" in out[-1]
    console.run(f"bench {tmp_path} {tmp_path}/out.tsv")
    assert [x.split("\t")[0] for x in (tmp_path / "out.tsv").read_text().splitlines()] == ["query", "sa", "sb"]
    head, *rows = [x.split("\t") for x in (tmp_path / "out.tsv").read_text().splitlines()]
    assert head[:4] == ["query", "millis", "rows", "parsing"] and {len(r) for r in rows} == {len(head)}
    assert [r[2] for r in rows] == ["1", "1"] and all(int(r[-1]) > 0 for r in rows)
    assert not console.run("quit")


def test_printing(spark):
    assert months(14) == "1 years 2 months" and months(-3) == "-0 years 3 months"
    assert iso_duration(datetime.timedelta(days=1, seconds=5)) == "PT24H5S"
    df = spark.sql("SELECT INTERVAL '14' MONTH AS m, INTERVAL '2' HOUR AS h, DATE '2020-01-02' AS d, true AS b, CAST(NULL AS INT) AS n")
    assert lines(df) == ["m\th\td\tb\tn", "1 years 2 months\tPT2H\t2020-01-02\ttrue\t[null]"]


def test_server(engine):
    server = serve(engine, port=0, max_rows=9)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path, method="GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(root + path, method=method)) as r:
                return r.status, r.read().decode(), r.headers
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode(), e.headers

    try:
        status, body, headers = get("/query?sql=" + urllib.parse.quote("SELECT 7 / 2 AS q, NULL AS n"))
        assert status == 200 and json.loads(body) == {"headers": ["q", "n"], "data": [["3", "[null]"]], "truncated": False} and headers["Access-Control-Allow-Origin"] == "*"
        ask = lambda sql: get("/query?sql=" + urllib.parse.quote(sql))
        many = json.loads(ask("SELECT id FROM range(12)")[1])
        assert len(many["data"]) == 9 and many["truncated"] is True
        for sql in ("DROP TABLE t", "CREATE TABLE t2 (a int)", "SELECT 1 AS a INTO t3", "CREATE VIEW v AS SELECT 1 AS a"):
            status, body, _ = ask(sql)
            assert status == 403 and "only queries" in body
        assert get("/query")[0] == get("/query?sql=%20")[0] == 400
        assert get("/query?sql=x", "POST")[0] == 405 and get("/query", "OPTIONS")[0] == 200 and get("/other")[0] == 404
        assert "error" in json.loads(get("/query?sql=SELEC")[1]) and "<textarea" in get("/")[1]
    finally:
        server.shutdown()


def test_follow_csv(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.csv").write_text(f"{k},x\n{k + 10},NULL\n")
        follow_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), schema, checkpoint=str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(0, "x"), (1, "x"), (10, None), (11, None)]


def test_database_is_made(spark):
    Database(spark, "Fresh_DB")
    assert spark.catalog.databaseExists("fresh_db")
    spark.sql("DROP DATABASE fresh_db")


def test_read_properties(tmp_path):
    from quern.session import read_properties

    (tmp_path / "c").write_text("# note\nspark.x = 1\n\ny=a=b\nnothing\n")
    assert read_properties(str(tmp_path / "c")) == {"spark.x": "1", "y": "a=b"}


def test_sorted_layout(spark, engine):
    engine.execute("CREATE TABLE t (a int primary key, d date)")
    engine.database.store("t", spark.createDataFrame([(k * 7919 % 1000, None if k % 9 == 0 else datetime.date(2020, 1, 1 + k % 28)) for k in range(1000)], engine.database.schema("t")), replace=True)
    before = sorted(map(tuple, engine.query("SELECT * FROM t").collect()), key=str)
    said = []
    console = Console(engine, said.append)
    console.run("index t D a")
    assert said == ["t lies in order of D, a"] and engine.database.tables() == ["t"]
    assert sorted(map(tuple, engine.query("SELECT * FROM t").collect()), key=str) == before
    assert engine.database.schema("t")["a"].metadata["keys"] == ["primary"]
    files = engine.query("SELECT min(d) AS low, max(d) AS high FROM t WHERE d IS NOT NULL GROUP BY input_file_name() ORDER BY low").collect()
    assert all(one.high <= other.low for one, other in zip(files, files[1:]))
    console.run("index t nope also")
    assert said[-1] == "Error: no columns ['nope', 'also'] to sort by"

"""Operator 2: round trips, the index, and its SQL."""

import gzip
import random

import duckdb
import pytest
from pyspark.sql import types as T

from quern.llm import warc
from quern.llm.queries_warc import ORACLE_SQL, op2_warc

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("digest", T.StringType()))])


def test_url_key():
    assert warc.url_key("https://www.Example.com:443/a/b?x=1#top") == "com,example)/a/b?x=1"
    assert warc.url_key("http://blog.example.co.uk:8080") == "uk,co,example,blog:8080)/"
    assert warc.url_key("http://www.com/") == "com,www)/"
    assert warc.url_key(None) == "" and warc.url_key("no url") == "no url" and warc.url_key("http://[bad") == "http://[bad"


def rows():
    random.seed(7)
    big = ["<p>é " + "x" * 200, "<b>" + "y" * 97, "y" * 99, "z" * 100]
    out = [(i, f"http://h{random.randint(0, 3)}.example.com/{i % 50}", random.choice([*big, f"page {i} " * 30, "", None])) for i in range(300)]
    out += [(400, None, None), (401, None, big[0]), (402, "odd\nurl", "q" * 300_000), (None, "http://a/", big[1]), (None, "http://a/", "only null " * 20), (None, None, "only null " * 20)]
    return out + [out[3], out[3], (5, out[5][1], "same key, other text " * 20)]


def run_sql(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    return sorted(con.execute(ORACLE_SQL["op2_warc"]).fetchall(), key=str)


@pytest.mark.parametrize("shared", [1, 50_000])
def test_query(spark, tmp_path, monkeypatch, shared):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "SHARED", shared)
    spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/a/pages.parquet")
    assert sorted(map(tuple, op2_warc(spark, f"{tmp_path}/a").collect()), key=str) == run_sql(f"{tmp_path}/a")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/pages.parquet")
    assert op2_warc(spark, f"{tmp_path}/b").collect() == []


def test_archives_and_index(spark, tmp_path):
    root = f"file:{tmp_path}/w"
    pages = spark.createDataFrame([(*r, "x") for r in rows()], SCHEMA).repartition(2)
    entries = warc.write_archives(pages, root, archive_bytes=3000)
    warc.write_index(entries, root, parts=3, block_lines=10)
    files = sorted((tmp_path / "w" / "warc").glob("*.warc.gz"))
    assert len(files) > 4 and not list((tmp_path / "w" / "warc").glob(".part*[!c]"))
    kinds = [x for f in files for x in gzip.decompress(f.read_bytes()).split(b"\r\n") if x.startswith(b"WARC-Type")]
    assert kinds.count(b"WARC-Type: warcinfo") == len(files) and len(kinds) == len(files) + len(rows())
    parts = [(r.part, r.urlkey, r.page_id) for r in spark.read.parquet(f"{root}/parts").collect()]
    index = warc.CaptureIndex(root, parts)
    for page_id, url, html in rows():
        found = [index.record(*c) for c in index.find(warc.url_key(url), page_id)]
        assert found and all(f["Page-Id"] == ("" if page_id is None else str(page_id)) for f, _ in found)
        if html and len({h for p, u, h in rows() if (p, u) == (page_id, url)}) == 1:
            f, payload = found[0]
            assert f["WARC-Type"] == "revisit" or payload == html.encode()
    # written once more, as by another attempt, the files are the same
    before = {f.name: f.read_bytes() for f in files}
    (tmp_path / "w" / "entries").rename(tmp_path / "w" / "entries-before")
    warc.write_archives(pages, root, archive_bytes=3000)
    assert {f.name: f.read_bytes() for f in (tmp_path / "w" / "warc").glob("*")} == before
    assert not list(index.find("com,nowhere)/", 1))
    index.blocks_read = 0
    list(index.find("com,example,h1)/7", 7))
    assert index.blocks_read <= 2


def test_a_revisit_without_its_response_fails(spark, tmp_path):
    root = f"file:{tmp_path}/w"
    pages = spark.createDataFrame([(1, "http://a/", "x" * 200, ""), (2, "http://b/", "x" * 200, "")], SCHEMA)
    entries = warc.write_archives(pages, root)
    warc.write_index(entries, root, parts=2)
    assert [tuple(r) for r in sorted(warc.read_back(pages, root, parts=2).collect())][1][3:] == ("revisit", 1)
    (tmp_path / "w" / "parts").rename(tmp_path / "w" / "parts-before")
    warc.write_index(entries.where("page_id = 2"), f"{root}/lost", parts=2)
    (tmp_path / "w" / "lost" / "warc").symlink_to(tmp_path / "w" / "warc")
    with pytest.raises(Exception, match="not the one written"):
        warc.read_back(pages.where("page_id = 2"), f"{root}/lost", parts=2).collect()


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, op2_warc(spark, sf).collect())) == sorted(con.execute(ORACLE_SQL["op2_warc"]).fetchall())

"""Operator 8 against brute force, its sketches, and its SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import quality_rules as Q
from quern.llm.queries_quality_rules import ORACLE_SQL, op8_quality_rules

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_words", T.StringType()), ("kept", T.StringType()))])


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(8)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def rows():
    random.seed(6)
    out = []
    for i in range(700):
        lang, source = random.choice(["en", "fr", None]), random.choice(["s1", "s1", "s2", None])
        words = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 9))) for _ in range(random.randint(15, 120))]
        text = "".join(w + random.choice("   \n\t") for w in words)
        if i % 50 == 0:
            text = text.replace(" ", "*** ")
        if i % 35 == 0:
            text += "\n" + (" ".join(words[:12]) + "\n") * random.randint(1, 4)
        out.append((i, text, lang, source, "x", None))
    out += [(i, t, "en", "s1", None, None) for i, t in enumerate([None, "", " \n \n", "one two", "x" * 5000 + " y" * 30, "a b c d e f g h i " * 9])]
    return out + [out[0], (None, *out[1][1:])]


def test_query(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = op8_quality_rules(spark, f"{tmp_path}/a").collect()
    want = sorted([(d, *base(t)) for d, t, *_ in rows()], key=str)
    assert sorted([tuple(r)[:-1] for r in got], key=str) == want
    texts = {r[0]: r[1] for r in rows()}
    assert not any(r.kept for r in got if r.base_failed)
    assert sum(r.kept for r in got) > 0.9 * sum(not r.base_failed and "***" not in texts[r.doc_id] for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/a/documents.parquet/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op8_quality_rules"]).fetchall(), key=str) == sorted(map(tuple, got), key=str)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op8_quality_rules(spark, f"{tmp_path}/b").collect() == []


def test_sketch_quantiles_merge(spark):
    rng = np.random.default_rng(1)
    values = np.r_[np.exp(rng.normal(0, 2, 3000)), np.zeros(200)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("bin", Q.bin_of(F.col("v")))
    sketch = df.repartition(7).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("bin", "n")).alias("s"))
    for q in (0.01, 0.25, 0.5, 0.75, 0.99):
        got = sketch.select(Q.bin_value(Q.quantile_bin(F.col("s"), q)).alias("x")).first().x
        assert abs(got - np.quantile(values, q, method="inverted_cdf")) <= 0.0011 * got


def words(rng, n, length, every=0):
    """n words of about ``length`` letters; one in ``every`` has symbols."""
    made = ["".join(rng.choice("abcdefgh") for _ in range(max(1, length + rng.randint(-2, 2)))) for _ in range(n)]
    return " ".join(w + "#$%" if every and i % every == 0 else w for i, w in enumerate(made))


def test_verdicts_follow_the_distribution(spark):
    """The same text is odd in one group and usual in another; only the groups differ."""
    rng = random.Random(2)
    long, marked = words(rng, 60, 14), words(rng, 60, 5, every=3)
    groups = {"short": (5, 0), "long": (14, 0), "marked": (5, 3)}
    rows = [(f"{g}-{i}", words(rng, rng.randint(40, 90), length, every), "en", g) for g, (length, every) in groups.items() for i in range(300)]
    # a few others, so that a tail is there
    rows += [(f"{g}-other-{i}", words(rng, 60, length, every or rng.randint(30, 59)), "en", g) for g, (length, every) in groups.items() for i in range(25)]
    rows += [(f"{name}-{g}", text, "en", g) for name, text in (("long", long), ("symbols", marked)) for g in groups]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in Q.judge(df, min_rows=20).collect()}
    assert [kept[f"long-{g}"] for g in groups] == [False, True, False]
    assert [kept[f"symbols-{g}"] for g in groups] == [False, False, True]
    assert all(kept[f"{g}-{i}"] for g in groups for i in range(300))


def test_documents(spark):
    """Junk goes, labelled good documents stay."""
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in op8_quality_rules(spark, sf).collect() if not r.base_failed}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()
    good = [kept[r.doc_id] for r in labels if r.doc_id in kept]
    assert sum(good) >= 0.99 * len(good)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()
    bad = [kept[r.doc_id] for r in labels if r.doc_id in kept]
    assert sum(bad) < 0.5 * len(bad)

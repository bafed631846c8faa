"""Operator 3: held-out accuracy, shrinkage, and odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from quern.llm import quality_classifier as C
from quern.llm.queries_quality_classifier import op3_quality_classifier

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("score", T.StringType()), ("id", T.StringType()))])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train, rest = labels.where("doc_id % 4 = 0"), labels.where("doc_id % 4 <> 0")
    done = C.classify(spark.read.parquet(f"{sf}/documents.parquet"), train)
    got = done.join(rest, done.id == rest.doc_id).select("kept", "quality").collect()
    assert len(got) > 2000
    # junk that gets through has a handful of words, hardly different from others'
    for kind, least in ((0, 0.975), (1, 0.995)):
        right = [r.kept == bool(kind) for r in got if r.quality == kind]
        assert sum(right) >= least * len(right), (kind, len(right) - sum(right))


@pytest.mark.parametrize("piece", [1, 2, 7, 64, 1000])
def test_pieces_give_the_same(monkeypatch, piece):
    texts = ["Some words WORDS words words | é!! " * 50, "x" * 3000, "one " + "y" * 500 + " y y\ty\n\n" + "é\x0by\r" * 40, " \n ", "a  a \x1f\x1f"]
    whole = [C.features(t) for t in texts]
    monkeypatch.setattr(C, "_PIECE", piece)
    for t, (n, x) in zip(texts, whole):
        assert C.features(t)[0] == n and (C.features(t)[1] == x).all()
    assert C.features(None)[0] == C.features(" \n")[0] == 0


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], DOCS)


GOOD, BAD = "A plain sentence of words, written well. Another one follows it.", "BUY!! NOW!! BUY!! NOW!! $$$ *** CHEAP!! CHEAP!! CHEAP!!"


def mixed():
    rows = [(i, GOOD + f" number{i}" if i % 3 else BAD + f" X{i}!!", "en", "clean" if i % 3 else "dirty") for i in range(300)]
    rows += [(1000, GOOD, "en", "dirty"), (1001, BAD, "fr", "clean"), (1002, GOOD, None, None), (1003, None, "en", "clean"), (1004, "", "en", "clean"), (1005, " \n", None, None)]
    return rows + [rows[1], rows[1], (None, GOOD, "en", "new")]


def test_posteriors_shrink(spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 300, 2)] + [(5, None), (None, 1), (7, 7)], LABELS)
    got = {r.id: r for r in C.classify(frame(spark, mixed()), labels).collect()}
    assert got[1].kept and got[2].kept and not got[0].kept and got[1000].kept and got[1002].kept and got[None].kept and not got[1001].kept
    for d in (1003, 1004, 1005):
        assert got[d].score == 0 and not got[d].kept
    assert got[1].path_posterior > 0.95 and got[3].path_posterior < 0.1
    # a site of one document has the prior of all
    mean = np.mean([r.evidence for r in C.classify(frame(spark, mixed()), labels).collect() if r.evidence > 0])
    assert got[1002].host_posterior == pytest.approx(mean, abs=0.05)
    kept = C.keep_good(frame(spark, mixed()), labels)
    assert kept.columns == DOCS.names
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in mixed() if got[r[0]].kept)


def brute_scores(evidence, prior, threshold=0.5, most=2.0):
    """(host and path posterior, score, kept) by id, from (id, host, path, evidence)."""
    some = [r for r in evidence if r[3] > 0]
    hosts, paths = {}, {}
    for _, h, p, e in some:
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, p), []).append(e)
    mean = sum(e for *_, e in some) / len(some)

    def strength(groups, means):
        n = sum(map(len, groups))
        rest = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, means)) - sum(m * (1 - m) for m in means)
        between = rest / max(n - len(groups), 1.0)
        within = sum(len(g) * m * (1 - m) for g, m in zip(groups, means)) / n
        return min(max(within / max(between, 1e-9) - 1, 1.0), 1e4)

    k_h = strength(list(hosts.values()), [mean] * len(hosts))
    m_h = {h: (sum(g) + k_h * mean) / (len(g) + k_h) for h, g in hosts.items()}
    k_p = strength(list(paths.values()), [m_h[h] for h, _ in paths])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = {}
    for d, h, p, e in some:
        host = (sum(hosts[h]) - e + k_h * mean) / (len(hosts[h]) - 1 + k_h)
        path = (sum(paths[h, p]) - e + k_p * host) / (len(paths[h, p]) - 1 + k_p)
        z = min(max(logit(path) - logit(mean), -most), most) + logit(mean) + logit(e) - logit(prior)
        out[d] = host, path, 1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-z)) >= threshold
    return out


@pytest.mark.parametrize("broadcast", [100_000, 7])
def test_scores_equal_brute_force(spark, broadcast, monkeypatch):
    """Thousands of sites of one document, and some of many, against plain loops."""
    monkeypatch.setattr(C, "BROADCAST_SITES", broadcast)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(4000):
        host = f"h{i}" if i % 2 else f"big{i % 3}"
        bad = rng.random() < (0.8 if host == "big0" else 0.2)
        text = " ".join(rng.permutation((BAD if bad else GOOD).split())[: rng.integers(1, 12)]) + f" {i}"
        rows.append((i, text, str(rng.choice(["en", "fr"])), host if i % 50 else None))
    labels = spark.createDataFrame([(i, int("!!" not in r[1])) for i, r in enumerate(rows) if i % 5 == 0], LABELS)
    got = C.classify(frame(spark, rows), labels).collect()
    evidence = {r.id: r.evidence for r in got}
    y = [int("!!" not in r[1]) for i, r in enumerate(rows) if i % 5 == 0]
    want = brute_scores([(d, h, p, evidence[d]) for d, _, p, h in rows], sum(y) / len(y))
    assert len(got) == len(want) == len(rows)
    for r in got:
        host, path, score, kept = want[r.id]
        assert (r.host_posterior, r.path_posterior, r.score) == pytest.approx((host, path, score), abs=1e-9)
        assert r.kept == kept or abs(score - 0.5) < 1e-9


def test_no_labels_and_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], LABELS)
    assert {r.id for r in C.classify(frame(spark, mixed()), none).collect() if not r.kept} == {1003, 1004, 1005}
    ones = spark.createDataFrame([(1, 1)], LABELS)
    assert {r.id for r in C.classify(frame(spark, mixed()), ones).collect() if not r.kept} == {1003, 1004, 1005}
    zeros = spark.createDataFrame([(1, 0)], LABELS)
    assert not any(r.kept for r in C.classify(frame(spark, mixed()), zeros).collect())
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    none.write.parquet(f"{tmp_path}/labels.parquet")
    assert op3_quality_classifier(spark, str(tmp_path)).collect() == []

"""The pipeline, stage by stage, against brute force over each stage's own input."""

import hashlib
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
import pytest

from quern.llm.byte_bpe import loaded
from quern.llm.queries_byte_bpe import RANKS

from .test_line_dedup import brute as line_brute
from .test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, found = docs.columns, {}
    for name, stage in P.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        found[name] = before, docs.collect()
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() > 0
    return found


def test_quality(stages, spark):
    before, after = stages["quality"]
    assert set(after) < set(before)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [r.doc_id in kept for r in before if quality.get(r.doc_id) == 1]
    bad = [r.doc_id in kept for r in before if quality.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    want = {(d, sha) for d, _, _, sha in line_brute([(r.doc_id, r.text) for r in before])}
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_simhash(stages):
    before, after = stages["simhash"]
    assert sorted(r.doc_id for r in after) == near_brute([(r.doc_id, r.text) for r in before])
    assert set(after) <= set(before)


def test_mixing(stages):
    before, after = stages["mixing"]
    texts = {r.doc_id: r.text for r in before}
    n = Counter()
    for r in after:
        assert " ".join(r.text.split()) in " ".join(texts[r.doc_id].split())
        n[r.doc_id] += len(r.text.split())
    assert all(n[d] <= 2 * len(texts[d].split()) for d in n)
    assert sum(n.values()) == pytest.approx(1.5 * sum(len(t.split()) for t in texts.values()), rel=0.02)


def test_byte_bpe(stages):
    before, after = stages["byte_bpe"]
    bpe = loaded(public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    ids = lambda t: [i for part in next(bpe.ids([t])) for i in part]
    want = Counter((r.doc_id, r.source, tuple(ids(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in before)
    assert Counter((r.doc_id, r.source, tuple(r.ids), r.decoded_sha256) for r in after) == want


def test_run(stages, spark):
    want = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in stages["byte_bpe"][1])
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in P.run(spark, SF).collect()) == want

"""Operator 10 against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from quern.llm import common, simhash
from quern.llm.queries_simhash import op10_simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows, most=4):
    """Expected (id, hex, component) of (id, fingerprint) rows."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(rows)), key=str)


def test_fingerprints():
    random.seed(1)
    texts = [None, "", " \n\t", "One", "a B c", "a b c d e", "É é x y z"]
    texts += [" ".join(random.choice("ab cd EF g h".split()) for _ in range(random.randint(1, 90))) for _ in range(100)]
    assert simhash._fingerprints(texts, 4) == [plain_fingerprint(t) for t in texts] == [simhash.fingerprint(t) for t in texts]


def test_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    monkeypatch.setattr(simhash, "_CHARS", 60)
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, "a b c", "x " * 29]
    assert simhash._fingerprints(texts, 4) == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 8, 11])
def test_embedding_bounds_and_cells_meet(most):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    other = fps.copy()
    for i in range(len(fps)):
        for k in rng.choice(64, rng.integers(0, most + 1), replace=False):
            other[i] ^= np.uint64(1 << int(k))
    for bits in (2, 4):
        apart = np.abs(simhash.embed(fps, bits).astype(int) - simhash.embed(other, bits)).sum(axis=1)
        assert (apart <= np.bitwise_count(fps ^ other)).all()
        (w1, c1), (w2, c2) = simhash.cells(fps, most, bits), simhash.cells(other, most, bits)
        met = {(i, c) for i, c in zip(w1.tolist(), c1.tolist())} & {(i, c) for i, c in zip(w2.tolist(), c2.tolist())}
        assert {i for i, _ in met} == set(range(300))


def clusters(n, seed):
    """Fingerprints that drift from a few centres by a few bits a step."""
    random.seed(seed)
    out = []
    for _ in range(n // 40):
        at = random.getrandbits(64)
        for _ in range(40):
            for k in random.sample(range(64), random.randint(0, 6)):
                at ^= 1 << k
            out.append(at)
    return out


@pytest.mark.parametrize("block", [20_000, 8])
def test_components_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "_SAMPLE", 2)
    if block == 8:  # most keys are shuffled
        monkeypatch.setattr(simhash, "join_keys", lambda *a, **b: common.join_keys(*a, **b, most=3))
    fps = clusters(600, 5)
    # a dense ball, whose cells hold many
    centre = random.getrandbits(64)
    fps += [centre ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in set(signed)], "fp long")
    edges = simhash.links(df, "fp", 4)
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(edges).collect()}
    want = brute(list(enumerate(fps)))
    comp = {i: c for i, _, c in want}
    for i, f in enumerate(fps):
        same = [j for j in comp if comp[j] == comp[i]]
        assert {got.get(fps[j], fps[j]) for j in same} == {got.get(f, f)}
    assert len({got.get(f, f) for f in fps}) == len(set(comp.values()))


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fingerprint", T.StringType())])


def test_query_on_odd_tables(spark, tmp_path):
    random.seed(9)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(random.choice(words) for _ in range(120)) for _ in range(30)]
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[:15]] + texts[:5] + [None, "", "  ", "a b"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, texts[4], "x"), (None, "all alone here", None)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = sorted(map(tuple, op10_simhash(spark, f"{tmp_path}/a").collect()), key=str)
    assert got == brute([(d, plain_fingerprint(t)) for d, t, _ in rows])
    assert op10_simhash(spark, f"{tmp_path}/b").collect() == []


@pytest.mark.parametrize("blocks", [2, 3, 9])
def test_split_cells_keep_all_meetings(blocks):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 400, dtype=np.uint64)
    who, what = np.r_[np.arange(400), np.arange(100)], np.r_[np.full(300, 7), np.full(100, -9), np.full(100, 12)]
    w, c = simhash.split_cells(who, what, fps, (np.array([-9, 7]), np.array([blocks, blocks])))
    met = {}
    for i, x in zip(w.tolist(), c.tolist()):
        met.setdefault(x, set()).add(i)
    for members in (range(300), range(300, 400), range(100)):
        assert all(any(i in m and j in m for m in met.values()) for i in list(members)[::17] for j in members)
    assert max(len(m) for x, m in met.items() if x != 12) <= 300 * min(1, 2.6 / blocks)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, op10_simhash(spark, sf).collect()), key=str)
    assert got == brute([(r.doc_id, plain_fingerprint(r.text)) for r in docs])

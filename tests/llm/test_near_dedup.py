"""The pipeline's near-dedup against brute-force overlap of shingles."""

import random

import corpus_pipeline as P
import numpy as np
import pytest

from quern.llm import near_dedup
from quern.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def overlap(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def near_pairs(texts):
    sets = [shingles(t) for t in texts]
    return [(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def brute(rows):
    """Ids that stay of (id, text) rows."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in near_pairs([t for _, t in rows]):
        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited(rng, words, n):
    """The words with n others in places apart from each other."""
    out = list(words)
    for i in rng.sample(range(0, len(words), 5), n):
        out[i] = f"new{rng.random()}"
    return out


def corpus(seed, hot):
    """Texts with copies of many overlaps around 0.8, and a group that all share most."""
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        texts += [" ".join(edited(rng, words, rng.randint(0, len(words) // 25))) for _ in range(3)]
    words = [f"h{i}" for i in range(150)]
    texts += [" ".join(edited(rng, words, rng.randint(1, 6))) for _ in range(hot)]
    rng.shuffle(texts)
    return texts


def kept(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return sorted(r.doc_id for r in P.simhash(spark, docs, SF).collect())


@pytest.mark.parametrize("block,common", [(512, 2), (16, 1)])
def test_all_of_overlap_080_are_found(spark, monkeypatch, block, common):
    monkeypatch.setattr(near_dedup, "_BLOCK", block)
    monkeypatch.setattr(near_dedup, "_PAIRED", block // 8)
    monkeypatch.setattr(near_dedup, "_COMMON", common)
    texts = corpus(3, 120)
    sets = [shingles(t) for t in texts]
    among = [overlap(sets[i], sets[j]) for i, j in near_pairs(texts)]
    assert sum(x < 0.9 for x in among) > 50
    rows = list(enumerate(texts))
    assert kept(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot,large", [(40, 30), (8, 5)])
def test_hot_shingles_meet_pivots_and_blocks(spark, monkeypatch, hot, large):
    for name, value in (("_SAMPLE", 1), ("_HOT", hot), ("_LARGE", large), ("_BLOCK", 16), ("_PAIRED", 4)):
        monkeypatch.setattr(near_dedup, name, value)
    dealt, plain = [], near_dedup._dealt
    monkeypatch.setattr(near_dedup, "_dealt", lambda *a: dealt.append(plain(*a)) or dealt[-1])
    rng = random.Random(7)
    words = [f"h{i}" for i in range(150)]
    # a second group and single texts have shingles of the first
    other = [f"o{i}" for i in range(75)] + words[:75]
    texts = corpus(6, 90) + [" ".join(edited(rng, other, rng.randint(1, 5))) for _ in range(60)]
    texts += [" ".join(words[:50] + [f"s{rng.random()}" for _ in range(60)]) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert kept(spark, rows) == brute(rows)
    assert dealt and not dealt[0].isEmpty()


def test_sets_of_one_label_do_not_meet(monkeypatch):
    monkeypatch.setattr(near_dedup, "_BLOCK", 10)
    rng = np.random.default_rng(2)
    n, label = rng.integers(50, 150, 300), rng.choice([1, 1, 1, 2, *range(10, 60)], 300)
    met = set()
    for rows in near_dedup._blocks(n, label, (4, 5)):
        assert len(rows) <= 20 and len(set(label[rows])) > 1
        met |= {(i, j) for i in rows.tolist() for j in rows.tolist() if i < j}
    for i in range(300):
        for j in range(i + 1, 300):
            if label[i] != label[j] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j]):
                assert (i, j) in met
    assert not list(near_dedup._blocks(n, np.ones(300, int), (4, 5)))


def test_near_sets_share_a_prefix_shingle():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        most = len(a) - -(-8 * len(a) // 9)  # so many shingles replaced leave 0.8
        gone = int(rng.integers(0, most + 1))
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64)])
        sketches = np.frombuffer(near_dedup.sketch(a) + near_dedup.sketch(b), np.uint64).reshape(2, -1)
        assert near_dedup.possible(np.array([len(a), len(b)]), sketches, (4, 5)).all()
        hot = np.sort(rng.permutation(a)[: n // 2])
        common = hot, rng.integers(4, 9, len(hot))
        assert near_dedup._near(len(np.intersect1d(a, b)), len(a), len(b), (4, 5))
        assert len(np.intersect1d(near_dedup.prefix(a, common, (4, 5)), near_dedup.prefix(b, common, (4, 5))))


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(r.doc_id for r in P.simhash(spark, docs, SF).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_short_texts_are_not_taken_for_empty_ones(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) for _ in range(1500)]
    texts = [t for t in texts if fingerprint(t, 5).bit_count() <= 8]
    assert len(texts) > 3
    rows = [(0, ""), (1, None), (2, " \n"), *((3 + i, t) for i, t in enumerate(texts))]
    assert kept(spark, rows) == [0, *range(3, 3 + len(texts))]


def test_fingerprints_of_sets(monkeypatch):
    monkeypatch.setattr(near_dedup, "_COUNTED", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 30, 7, 0, 2, 14, 3, 0)]
    want = [sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s)) for s in sets]
    assert near_dedup.fingerprints(sets).tolist() == want
    assert not len(near_dedup.fingerprints([]))


@pytest.mark.parametrize("block", [512, 8])
def test_fingerprints_meet_first(spark, monkeypatch, block):
    """Links come from the grid join of fingerprints; prefixes are left what it does not find."""
    monkeypatch.setattr(near_dedup, "_BLOCK", block)
    met, plain = [], near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda m, *a: met.append(m.distinct().collect()) or plain(m, *a))
    rng = random.Random(11)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        # 14 near copies, and one that shares too little
        texts += [" ".join(edited(rng, words, rng.randint(0, 1))) for _ in range(14)] + [" ".join(words[:200] + [f"n{rng.random()}" for _ in range(200)])]
    sets = [shingles(t) for t in texts]
    rows = list(enumerate(texts))
    assert kept(spark, rows) == brute(rows)
    hashes = [near_dedup.shingle_set(t, 5) for t in texts]
    near = near_pairs(texts)
    assert len(near) > 1000
    # every near text was compared in the search by fingerprints; no near two met again by prefixes
    key = lambda i: near_dedup.xxhash.xxh64_intdigest(hashes[i].tobytes())
    found = {r.key & (2**64 - 1) for r in met[0]}
    assert found >= {key(i) for p in near for i in p if sets[p[0]] != sets[p[1]]}
    assert len(met) == 2
    close, groups = {frozenset((key(i), key(j))) for i, j in near}, {}
    for r in met[1]:
        groups.setdefault(r.group, set()).add(r.key & (2**64 - 1))
    assert not close & {frozenset(g) for g in groups.values()}

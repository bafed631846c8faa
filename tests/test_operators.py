"""Joins and the multi-way join against plain ones."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators import multiway
from quern.operators import anti_join, band_join, multiway_join, salted_join, semi_join
from quern.operators.multiway import join_cell, shares


def brute(relations):
    """Multiplicity of each binding of a natural join."""
    order = list(dict.fromkeys(v for _, own in relations for v in own))
    found = Counter()
    for rows in itertools.product(*(r for r, _ in relations)):
        bound = {}
        if all(bound.setdefault(v, x) == x and x is not None for row, (_, own) in zip(rows, relations) for v, x in zip(own, row)):
            found[tuple(sorted(bound.items()))] += 1
    return found, order


SHAPES = [
    [["a", "b"], ["b", "c"], ["c", "a"]],
    [["a", "b"], ["b", "c"], ["c", "d"], ["d", "a"]],
    [["a", "b"], ["a", "c"], ["a", "d"]],
    [["a", "b"], ["c"]],
    [["a", "b", "c"], ["b", "c"], ["c", "a"]],
]


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(SHAPES), st.integers(0, 10**6))
def test_cell_join(shape, seed):
    rng = random.Random(seed)
    relations = [([tuple(rng.randint(-2, 3) for _ in own) for _ in range(rng.randint(0, 7))], own) for own in shape]
    want, order = brute(relations)
    packed = []
    for rows, own in relations:
        c = Counter(rows)
        packed.append((own, [np.array([k[i] for k in c], np.int64) for i in range(len(own))], np.array(list(c.values()), np.int64)))
    got = Counter()
    for rows, m in join_cell(packed, order):
        for row, n in zip(rows.tolist(), m.tolist()):
            got[tuple(sorted(zip(order, row)))] += n
    assert got == want


@pytest.mark.parametrize("shape", SHAPES[:4])
def test_multiway(spark, shape):
    rng = random.Random(len(shape))
    relations = [([tuple(rng.choice([None, 1, 2, 3, 4, 5, 9]) for _ in own) for _ in range(14)], own) for own in shape]
    frames = [(spark.createDataFrame(rows, ", ".join(f"x{i} int" for i in range(len(own)))), own) for rows, own in relations]
    want, _ = brute(relations)
    got = {tuple(sorted((k, v) for k, v in r.asDict().items() if k != "multiplicity")): r.multiplicity for r in multiway_join(frames, cells=8).collect()}
    assert got == dict(want)
    assert sum(r[0] for r in multiway_join(frames, cells=8, count_only=True).collect()) == sum(want.values())


def test_multiway_takes_integers_only(spark):
    a = spark.createDataFrame([(1.2, 1)], "x double, y int")
    with pytest.raises(TypeError, match="no integers"):
        multiway_join([(a, ["a", "b"])], cells=2)


def test_multiway_streams_its_blocks(spark, monkeypatch):
    """Several cells in a task, and several blocks from a cell."""
    monkeypatch.setattr(multiway, "_FRONTIER", 5)
    e = spark.createDataFrame([(i, j) for i in range(12) for j in range(12)], "src int, dst int")
    found = multiway_join([(e, ["a", "b"]), (e, ["b", "c"]), (e, ["c", "a"])], cells=16).coalesce(2)
    assert found.count() == found.distinct().count() == 12**3


def test_shares():
    assert shares([10**6] * 3, [["a", "b"], ["b", "c"], ["c", "a"]], ["a", "b", "c"], 64) == {"a": 4, "b": 4, "c": 4}
    assert shares([10, 10**6], [["a"], ["a", "b"]], ["a", "b"], 8) == {"a": 8, "b": 1}


def test_cliques(spark):
    edges = [(a, b) for a in range(1, 5) for b in range(a + 1, 5)] + [(4, 5), (5, 6)]
    e = spark.createDataFrame(edges, "src int, dst int")
    triangles = multiway_join([(e, ["a", "b"]), (e, ["b", "c"]), (e, ["a", "c"])], cells=4)
    assert triangles.count() == 4
    four = multiway_join([(e, list(p)) for p in itertools.combinations("abcd", 2)], cells=4)
    assert [tuple(r) for r in four.select("a", "b", "c", "d").collect()] == [(1, 2, 3, 4)]


def test_semi_and_anti(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (1,)], "y int")
    got = lambda df: sorted((r[0] for r in df.collect()), key=str)
    assert got(semi_join(a, b, a.x == b.y)) == [1]
    assert got(anti_join(a, b, "x", "y")) == [2, None]
    assert got(anti_join(a, b, "x", "y", null_aware=True)) == [2]
    assert got(anti_join(a, b.union(spark.createDataFrame([(None,)], "y int")), "x", "y", null_aware=True)) == []
    assert got(anti_join(a, b.where("y > 5"), "x", "y", null_aware=True)) == [1, 2, None]


def test_salted_and_band(spark):
    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 99)], "k int, v int")
    small = spark.createDataFrame([(1, "a"), (3, "c")], "k int, s string")
    assert salted_join(big, small, ["k"], 4).count() == 50
    assert salted_join(big, small, ["k"], 4, "left").where("s IS NULL").count() == 1
    left = spark.createDataFrame([(float(i) / 3,) for i in range(-30, 30)], "v double")
    right = spark.createDataFrame([(-3.5, 2.0), (1.0, 1.0), (5.0, 4.0)], "lo double, hi double")
    assert sorted(map(tuple, band_join(left, right, "v", "lo", "hi", 0.7).collect())) == sorted(map(tuple, left.join(right, (left.v >= right.lo) & (left.v <= right.hi)).collect()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(0, 3)), min_size=1, max_size=30))
def test_packed_blocks(rows):
    columns = [np.array([r[k] for r in rows], np.int64) for k in range(2)]
    assert [c.tolist() for c in multiway.unpack(multiway.pack(columns), 2)] == [c.tolist() for c in columns]


def test_packed_blocks_are_small():
    rng = np.random.default_rng(1)
    edges = np.unique(rng.integers(0, [1_200_000, 60_000], (50_000, 2)), axis=0)
    assert len(multiway.pack([edges[:, 0], edges[:, 1], np.ones(len(edges), np.int64)])) < 4 * len(edges)


@pytest.mark.parametrize("shape", SHAPES[:4])
def test_finer_cells(spark, monkeypatch, shape):
    """Tasks don't follow the shuffle's partitions, and join their cells in parts."""
    rng = random.Random(len(shape))
    relations = [([tuple(rng.choice([None, 1, 2, 3, 4, 5, 9]) for _ in own) for _ in range(14)], own) for own in shape]
    frames = [(spark.createDataFrame(rows, ", ".join(f"x{i} int" for i in range(len(own)))), own) for rows, own in relations]
    want, _ = brute(relations)
    monkeypatch.setattr(multiway, "CELL_ROWS", 2)
    monkeypatch.setattr(multiway, "TASKS", 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = multiway_join(frames)
        assert found.rdd.getNumPartitions() <= 4
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {tuple(sorted((k, v) for k, v in r.asDict().items() if k != "multiplicity")): r.multiplicity for r in rows} == dict(want)

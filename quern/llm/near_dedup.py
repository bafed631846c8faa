"""Near-duplicate removal by the overlap of word shingles (a stage of the pipeline).

Method: SimHash, as in ``simhash``: fingerprints are embedded by their segments' bit counts
and joined in a grid under Manhattan distance; texts whose fingerprints are connected there
are compared exactly, by the overlap of their shingles, before they are linked.

Fingerprints within a few bits miss many pairs of overlap 0.8, so an exact search for the
rest follows, prefix filtering, which misses none. Texts that are linked already do not
meet in it. Shingles have one order for all texts,
common ones last. Of two texts whose shingle sets overlap by ``least`` or more, the first
few shingles in this order, a fifth of them at 0.8, have one in common. So texts meet at
these shingles. Of what meets in either search, sketches rule out sets that surely differ in
too much: two sketches differ in no more bits than the sets in shingles. What is left is
compared exactly, shingle by shingle, before it is linked.

Scale: texts of equal shingles collapse first. A class of fingerprints is compared as a whole, or
in chunks with a pivot if it is large. A shingle that few texts share gives pairs,
one of many gives groups of bounded size, a spanning forest of whose links is kept. Where very
many texts share one, all are first compared with one of them, its pivot, in chunks: what is
linked by that is not compared among itself, and the rest is dealt in blocks of bounded
size. So a group of near copies costs as much as it has texts, not their square, and no
task holds a shingle's texts. Only texts that sketches leave are read again. The order and
the list of such shingles come from samples; they move work, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW_KEY, cut, fresh_path, join_keys, none_of, with_keys
from .simhash import _ones, _packed, components, links, shingle_hashes

#: Least overlap of near-duplicates: intersection over union, as a fraction.
LEAST = (4, 5)
#: Differing bits of fingerprints that meet in the grid.
MAX_BITS = 8
#: Shingles whose bits are counted at a time: 64 bytes each.
_COUNTED = 65_536
#: One text in so many is looked at for common shingles, and a shingle is common in so many of them.
_SAMPLE, _COMMON, _MOST_COMMON = 8, 2, 500_000
#: Texts at a shingle that are paired; more are grouped, by twice so many at most.
_PAIRED, _BLOCK = 64, 512
#: Texts at a shingle that first meet a pivot, shingles that have one (those of most texts),
#: and rows of a block of what the pivot leaves.
_HOT, _MOST_HOT, _LARGE = 1024, 100_000, 20_000
#: A sketch has 2 ** _SKETCH bits, of which each shingle turns one.
_SKETCH = 11
#: Texts that met are broadcast up to this number.
_FEW = 100_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes in rising order; a text without words has none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of every set, as in ``simhash`` but each distinct shingle counts once."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, of = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    ones = np.zeros((len(sets), 64), np.int64)
    for i in range(0, len(flat), _COUNTED):
        who = of[i : i + _COUNTED]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        ones[who[first]] += np.add.reduceat(_ones(flat[i : i + _COUNTED]), first, axis=0, dtype=np.int32)
    return np.array(_packed(ones, sizes), np.uint64)


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, texts of the sample with it) of common shingles, in order of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                sets = [shingle_set(t, width) for t in batch.column(0).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    sampled = texts.where(F.pmod(F.xxhash64("__id", "__row"), F.lit(_SAMPLE)) == 0).select("__text")
    counted = sampled.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= _COMMON)
    rows = counted.orderBy(F.desc("n"), "shingle").limit(_MOST_COMMON).toArrow()
    shingle, n = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """The first shingles of a set, in the order of all, of which near sets share one."""
    if not len(own):
        return own
    size = len(own) + least[0] * len(own) // -least[1] + 1
    shingle, n = common
    if not len(shingle):
        return own[:size]
    at = np.minimum(np.searchsorted(shingle, own), len(shingle) - 1)
    return own[np.argsort(np.where(shingle[at] == own, n[at], 0), kind="stable")[:size]]


def _near(both, a, b, least: tuple[int, int]):
    """Whether sets of a and b shingles with ``both`` in common overlap by ``least``."""
    return least[1] * both >= least[0] * (a + b - both)


def sketch(own: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in each of the sketch's places."""
    odd = np.bincount((own >> np.uint64(64 - _SKETCH)).astype(np.int64), minlength=1 << _SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def possible(n: np.ndarray, sketches: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Which of a group's sets may be near another one, by all their sketches."""
    found = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        apart = np.bitwise_count(sketches[i] ^ sketches[i + 1 :]).sum(axis=1, dtype=np.int64)
        both = (n[i] + n[i + 1 :] - apart) // 2
        ok = _near(both, n[i], n[i + 1 :], least)
        found[i] |= ok.any()
        found[i + 1 :] |= ok
    return found


def _group(keys: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(np.sort(keys).tobytes())


def _met(cell: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(group, key) of what is to be compared; the cells lie in order.

    In pairs, a shingle counts only if it can be the first that two near sets share: then
    no more than what follows it, and itself, is common to both. Sets of equal label are
    linked already and need not meet.
    """
    size = len(cell)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if size else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, size])
    groups, keys = [], []
    at = np.flatnonzero(np.repeat(sizes <= _PAIRED, sizes))
    for lag in range(1, _PAIRED):
        at = at[at < size - lag]
        at = at[cell[at] == cell[at + lag]]
        if not len(at):
            break
        a, b = n[at], n[at + lag]
        left = np.minimum(np.minimum(a, b), np.minimum(a - pos[at], b - pos[at + lag]))
        near = at[_near(left, a, b, least) & (label[at] != label[at + lag])]
        pairs = np.sort(np.stack([key[near], key[near + lag]], axis=1), axis=1)
        ids = np.fromiter((xxhash.xxh64_intdigest(p.tobytes()) for p in pairs), np.uint64, len(pairs))
        groups.append(np.repeat(ids, 2))
        keys.append(pairs.ravel())
    for start, count in zip(first[sizes > _PAIRED], sizes[sizes > _PAIRED]):
        for rows in _blocks(n[start : start + count], label[start : start + count], least):
            members = key[start + rows]
            groups.append(np.full(len(members), _group(members), np.uint64))
            keys.append(members)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(groups), np.concatenate(keys)) if groups else (none, none)


def _blocks(n: np.ndarray, label: np.ndarray, least: tuple[int, int]) -> Iterator[np.ndarray]:
    """Places of what is to meet: two blocks each, whose sizes and labels allow links."""
    _, of, times = np.unique(label, return_inverse=True, return_counts=True)
    shared = np.where(times[of] > 1, of, -1)
    rows = np.lexsort((n, shared))
    blocks = [rows[i : i + _BLOCK] for i in range(0, len(rows), _BLOCK)]
    low, high = (np.array([f(n[b]) for b in blocks]) for f in (np.min, np.max))
    # the label of a block that has one only
    own = np.array([shared[b[0]] if shared[b[0]] == shared[b[-1]] else -1 for b in blocks])
    i, j = np.triu_indices(len(blocks), 1)
    close = (least[1] * high[i] >= least[0] * low[j]) & (least[1] * high[j] >= least[0] * low[i]) & ((own[i] < 0) | (own[i] != own[j]))
    i, j = i[close], j[close]
    yield from (np.concatenate([blocks[a], blocks[b]]) for a, b in zip(i, j))
    yield from (blocks[a] for a in np.setdiff1d(np.flatnonzero(own < 0), np.r_[i, j]))


def linked(keys: list[int], sets: list[np.ndarray], least: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets, each found by comparing two of them."""
    m = len(sets)
    if m == 2:
        a, b = sets
        return [(keys[0], keys[1])] if _near(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), least) else []
    own, local = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    label, out = np.arange(m), []
    for i in range(m - 1):
        rest = local[ends[i] :]
        if (label[i:] == label[i]).all():
            continue
        there = np.zeros(len(own), np.int32)
        there[local[ends[i] - sizes[i] : ends[i]]] = 1
        both = np.add.reduceat(there[rest], ends[i:-1] - ends[i])
        for j in (i + 1 + np.flatnonzero(_near(both, sizes[i], sizes[i + 1 :], least))).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((keys[i], keys[j]))
    return out


def _compared(met: DataFrame, distinct: DataFrame, texts: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """(a, b): a spanning forest of the links inside each (group, key) of ``met``."""

    def rule_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sizes, sketches = None, [], [], []

        def out() -> list[tuple[int, int]]:
            left = np.zeros(0, np.int64)
            if len(keys) > 1:
                left = np.array(keys)[possible(np.array(sizes), np.frombuffer(b"".join(sketches), np.uint64).reshape(len(keys), -1), least)]
            return [(group, k) for k in left.tolist()]

        for batch in batches:
            found = []
            for g, k, n, s in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if g != group:
                    found += out()
                    group, keys, sizes, sketches = g, [], [], []
                keys.append(k)
                sizes.append(n)
                sketches.append(s)
            yield _pairs(found, "group", "key")
        yield _pairs(out(), "group", "key")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, width).view(np.int64) for t in part.column("__text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sets = None, [], []
        found: list[tuple[int, int]] = []
        for batch in batches:
            lists = batch.column("shingles")
            for i, (g, k) in enumerate(zip(batch.column("group").to_pylist(), batch.column("key").to_pylist())):
                if g != group:
                    found += linked(keys, sets, least) if len(keys) > 1 else []
                    group, keys, sets = g, [], []
                keys.append(k)
                sets.append(lists[i].values.to_numpy().copy())
            yield _pairs(found, "a", "b")
            found = []
        yield _pairs(linked(keys, sets, least) if len(keys) > 1 else [], "a", "b")

    sketched = met.join(distinct, "key").select("group", "key", "n", "sketch").repartition("group").sortWithinPartitions("group")
    met = cut(sketched.mapInArrow(rule_out, "group long, key long"))
    wanted = cut(met.select("key").distinct().join(distinct, "key").select("key", F.col("first.id").alias("__k"), F.col("first.row").alias("__r")))
    if wanted.count() <= _FEW:
        wanted = F.broadcast(wanted)
    again = texts.join(wanted, F.col("__id").eqNullSafe(F.col("__k")) & (F.col("__row") == F.col("__r"))).select("key", "__text")
    sets = again.mapInArrow(read, "key long, shingles array<long>").dropDuplicates(["key"])
    together = met.join(sets, "key").select("group", "key", "shingles").repartition("group").sortWithinPartitions("group", "key")
    return together.mapInArrow(compare, "a long, b long").distinct()


def _written(df: DataFrame) -> DataFrame:
    """``df`` written and read again, so that its size is known.

    A checkpoint keeps the estimated size, for joins a product: components of components
    would get numbers of millions of digits, which the planner multiplies for minutes.
    """
    path = fresh_path(df.sparkSession, "near-dedup")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _classes(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(cell, key, n_cell, label) of texts that share their class of fingerprints with others.

    A class is what the grid join of ``simhash`` connects: fingerprints within ``max_bits``.
    """
    fps = cut(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("n_keys")))
    tree = _written(components(links(fps, "fp", max_bits)))
    rooted = cut(fps.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "n_keys", F.coalesce("root", "fp").alias("root")))
    several = rooted.groupBy(F.col("root").alias("cell")).agg(F.sum("n_keys").alias("n_cell"), F.count(F.lit(1)).alias("n_fps")).where("n_cell > 1")
    classes = join_keys(rooted, cut(several), [F.col("root") == F.col("cell")], weight="n_fps", how="inner")
    classes = cut(classes.select(F.col("fp").alias("f2"), "n_keys", "cell", "n_cell"))
    rows = join_keys(distinct.select("key", "fp"), classes, [F.col("fp") == F.col("f2")], weight="n_keys", how="inner")
    return rows.select("cell", "key", "n_cell", F.col("key").alias("label"))


def _searched(distinct: DataFrame, texts: DataFrame, width: int, least: tuple[int, int], max_bits: int) -> DataFrame:
    """(a, b): keys of near sets, of those whose fingerprints are connected within ``max_bits``.

    All are found that are connected by near sets inside a class of up to ``_BLOCK`` texts;
    of a larger class, those that are so inside a chunk and its pivot.
    """
    rows = _written(_classes(distinct, max_bits))
    whole = rows.where(F.col("n_cell") <= _BLOCK).select(F.col("cell").alias("group"), "key")
    large = _pivoted(rows.where(F.col("n_cell") > _BLOCK))
    return _written(_compared(whole.union(large), distinct, texts, width, least))


def _hot(distinct: DataFrame) -> DataFrame:
    """(cell, n_cell) of shingles at which very many texts meet, by a sample of the texts."""
    few = distinct.where(F.pmod(F.xxhash64("key"), F.lit(_SAMPLE)) == 0).select(F.explode("prefix").alias("cell"))
    counted = few.groupBy("cell").agg((F.count(F.lit(1)) * _SAMPLE).alias("n_cell")).where(F.col("n_cell") > _HOT)
    return cut(counted.orderBy(F.desc("n_cell"), "cell").limit(_MOST_HOT))


def _pivoted(rows: DataFrame) -> DataFrame:
    """(group, key): chunks of the texts of every cell, and its pivot with each.

    Texts that have the pivot's label are linked to it already and left out.
    """
    chunks = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_cell") / _BLOCK))).cast("long"))
    pivots = rows.groupBy("cell").agg(F.min(F.struct(F.xxhash64("key").alias("h"), "key", "label")).alias("first"))
    pivots = pivots.select("cell", F.col("first.key").alias("pivot"), F.col("first.label").alias("major"))
    dealt = rows.join(F.broadcast(pivots), "cell").where("label <> major")
    dealt = dealt.select("key", "pivot", F.xxhash64("pivot", chunks, F.pmod(F.xxhash64("key", F.lit(1)), chunks)).alias("group"))
    return dealt.select("group", "key").union(dealt.select("group", F.col("pivot").alias("key"))).distinct()


def _dealt(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """Rows (cell, key, n, pos, label) of hot shingles in cells of bounded size.

    A shingle's major label is its pivot's. Of what has another one, every two blocks
    meet, and each meets every block of the major ones; these don't meet each other.
    """
    label = F.coalesce("root", "key").alias("label")
    rows = cut(rows.drop("label").join(tree, F.col("key") == F.col("node"), "left").select("cell", "key", "n", "pos", label))
    majors = rows.groupBy("cell").agg(F.min(F.struct(F.xxhash64("key").alias("h"), "label"))["label"].alias("major"))
    minor = F.col("label") != F.col("major")
    blocks = lambda what: F.ceil(F.count_if(what) / _LARGE)
    rows = rows.join(F.broadcast(majors), "cell")
    shape = rows.groupBy("cell").agg(blocks(minor).alias("minors"), blocks(~minor).alias("others")).where("minors > 0")
    rows = rows.join(F.broadcast(cut(shape)), "cell")
    own = F.pmod(F.xxhash64("key", F.lit(2)), F.when(minor, F.col("minors")).otherwise(F.col("others")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    named = lambda kind, i, j: F.xxhash64("cell", F.lit(kind), i, j)
    among = F.transform(F.filter(upto("minors"), lambda j: j != own), lambda j: named(0, F.least(own, j), F.greatest(own, j)))
    to_major = F.transform(upto("others"), lambda k: named(1, own, k))
    to_minor = F.transform(upto("minors"), lambda i: named(1, i, own))
    cells = F.when(minor, F.concat(among, to_major)).otherwise(to_minor)
    return rows.select(F.explode(cells).alias("cell"), "key", "n", "pos", "label")


def _rest(distinct: DataFrame, texts: DataFrame, searched: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """(a, b): keys of ``distinct`` that with ``searched`` connect all those of near sets, and no others."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5

        def out(part: list[np.ndarray]) -> pa.RecordBatch:
            groups, keys = _met(*part, least)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (groups, keys)], names=["group", "key"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy().astype(np.int64)]) for k, h in enumerate(held)]
            if len(held[0]) < 200_000:
                continue
            whole = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on
            if whole:
                yield out([h[:whole] for h in held])
                held = [h[whole:] for h in held]
        yield out(held)

    tree = _written(components(searched))
    few = F.broadcast(tree) if tree.count() <= _FEW else tree
    labelled = distinct.join(few, F.col("key") == F.col("node"), "left").select("key", "n", "prefix", F.coalesce("root", "key").alias("label"))
    cells = labelled.select("key", "n", "label", F.posexplode("prefix").alias("pos", "cell")).select("cell", "key", "n", "pos", "label")
    hot, found, rows = _hot(distinct), None, cells
    if not hot.isEmpty():
        rows = rows.join(F.broadcast(hot), "cell", "left_anti")
        at_hot = cut(cells.join(F.broadcast(hot), "cell"))
        found = _written(_compared(_pivoted(at_hot), distinct, texts, width, least))
        if not found.isEmpty():
            tree = _written(components(searched.union(found)))
        rows = rows.unionByName(_dealt(at_hot, tree))
    met = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "group long, key long").distinct()
    more = _compared(met, distinct, texts, width, least)
    return more if found is None else more.union(found)


def _pairs(found: list[tuple[int, int]], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=list(names))


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: tuple[int, int] = LEAST, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, with all its columns.

    Near-duplicates are texts whose sets of word shingles overlap (intersection over union)
    by ``least`` or more, and texts connected through such. All of them are found, first by
    fingerprints within ``max_bits``, the rest by prefixes; shingles are told apart by 64 bits of
    hash. A text of fewer words than a shingle is one shingle;
    texts without words, null ones too, are near each other only.

    A null id is larger than all others. Of several rows of the smallest id, the one whose
    text has the smallest hash stays; of rows of equal id and text, any one.
    """
    texts = df.select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__row"), F.col(text_col).alias("__text"))
    common = _common(texts, width)
    schema = T.StructType(
        [texts.schema["__id"], T.StructField("__row", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("fp", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, width) for t in part.column("__text").to_pylist()]
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                prefixes = pa.array([prefix(s, common, least).view(np.int64) for s in sets], pa.list_(pa.int64()))
                columns = [part.column("__id"), part.column("__row"), pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), prefixes, pa.array([sketch(s) for s in sets], pa.binary()), pa.array(fingerprints(sets).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    first = F.min(F.struct(F.col("__id").isNull().alias("null"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    own = texts.mapInArrow(run, schema)
    distinct = cut(own.groupBy("key").agg(first.alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp")))
    searched = _searched(distinct, texts, width, least, max_bits)
    found = _written(searched.union(_rest(distinct, texts, searched, width, least)))
    tree = _written(components(found))
    rooted = distinct.select("key", "first").join(tree, F.col("key") == F.col("node"), "left")
    kept = rooted.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("k")).select(F.col("k.id").alias("__k"), F.col("k.row").alias("__r")).distinct()
    kept = kept.select(F.coalesce("__k", none_of(df, id_col)).alias("__k"), F.col("__k").isNull().alias("__null"), "__r")
    keyed = with_keys(df, id_col, text_col)
    chosen = keyed.join(kept, (F.col("__id") == F.col("__k")) & (F.col("__no_id") == F.col("__null")) & (F.col("__row") == F.col("__r")), "left_semi")
    # dealt and sorted by the join already
    nth = F.row_number().over(W.partitionBy(*ROW_KEY).orderBy("__row"))
    return chosen.withColumn("__nth", nth).where("__nth = 1").select(*df.columns)

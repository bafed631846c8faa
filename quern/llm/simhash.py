"""SimHash near-duplicate detection (operator 10).

Method: a fingerprint's 64 bits are cut into segments, and the vector of the segments'
bit counts embeds it so that Manhattan distance never exceeds Hamming distance. Of a few
parts of the embedding, two vectors within ``max_bits`` agree on one to within two; such
parts share a grid cell at or beside both, the one halfway between them. So every distinct
fingerprint is put into the cells around all of its parts, and only fingerprints that meet
in a cell are compared, exactly, by their differing bits.

Scale: exact copies collapse to one fingerprint before the join, each fingerprint makes a
fixed number of cell rows, and a cell yields a spanning forest of its links, never all
pairs. A cell of many fingerprints is split into blocks, of which every two meet in a group
of their own. Components come from min-label contraction in DataFrames, cut by checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_keys

#: Shingles whose bits are counted at a time: 64 bytes each.
_BLOCK = 65_536
#: Bytes of documents that share a round of counting.
_CHARS = 1_000_000
SEGMENT_BITS = 2
#: Fingerprints of a cell's block, about, and cells that are split, at most: the largest.
BLOCK, MOST_SPLIT = 20_000, 100_000
#: One fingerprint in so many is looked at for large cells; it moves work, not results.
_SAMPLE = 16


# -- fingerprints -------------------------------------------------------------------


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 (seed 42) of the text's word shingles, in blocks.

    Words are split at ASCII white space after lower-casing A-Z. A text of fewer words is
    one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _BLOCK):
        m = min(n, i + _BLOCK) - i
        yield np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[i : i + m], stops[i : i + m])), np.uint64, m)


def fingerprint(text: str | None, width: int = 4) -> int:
    """Bit k is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        ones += _ones(h).sum(axis=0, dtype=np.int64)
        n += len(h)
    return _packed(ones[None, :], np.array([n]))[0]


def _ones(hashes: np.ndarray) -> np.ndarray:
    """0/1 for each hash and bit, lowest bit first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(ones: np.ndarray, n: np.ndarray) -> list[int]:
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel().tolist()


def _fingerprints(texts: list[str | None], width: int) -> list[int]:
    """As :func:`fingerprint`; short texts are counted together."""
    out: list[int] = [0] * len(texts)
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            sizes = np.array([len(h) for _, h in held])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            sums = np.add.reduceat(_ones(np.concatenate([h for _, h in held])), starts, axis=0, dtype=np.int32)
            for (i, _), fp in zip(held, _packed(sums, sizes)):
                out[i] = fp
            held.clear()

    total = 0
    for i, t in enumerate(texts):
        if len(t or "") > _CHARS:
            out[i] = fingerprint(t, width)
            continue
        for h in shingle_hashes(t, width):
            if len(h) == _BLOCK:
                out[i] = fingerprint(t, width)
                break
            held.append((i, h))
            total += len(h)
        if total >= _BLOCK:
            flush()
            total = 0
    flush()
    return out


def with_fingerprints(df: DataFrame, *, keys: list[str], text_col: str, width: int, name: str) -> DataFrame:
    """``keys`` and the fingerprint, as a signed long, of every row's whole text."""
    source = df.select(*keys, F.col(text_col).alias("__text"))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField(name, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                fps = np.array(_fingerprints(part.column("__text").to_pylist(), width), np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(fps.view(np.int64))], names=[*keys, name])

    return source.mapInArrow(run, schema)


# -- links --------------------------------------------------------------------------


def embed(fps: np.ndarray, segment_bits: int = SEGMENT_BITS) -> np.ndarray:
    """Bit counts of the segments: one row for each fingerprint."""
    return _ones(fps).reshape(len(fps), 64 // segment_bits, segment_bits).sum(axis=2, dtype=np.int8)


def _moves(dims: int) -> np.ndarray:
    """All integer vectors of Manhattan length 0 or 1."""
    one = np.eye(dims, dtype=np.int64)
    return np.concatenate([np.zeros((1, dims), np.int64), one, -one])


def cells(fps: np.ndarray, max_bits: int, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, cell) for the cells around all parts of its vector.

    With p parts, one part of two vectors within ``max_bits`` is within ``max_bits // p``;
    p is such that this is 2 at most. The cells within 1 around each have one in common.
    """
    vectors = embed(fps, segment_bits).astype(np.int64)
    parts = max_bits // 3 + 1
    who, what = [], []
    for part, dims in enumerate(np.array_split(np.arange(vectors.shape[1]), parts)):
        own = vectors[:, dims]
        powers = (segment_bits + 1) ** np.arange(len(dims), dtype=np.int64)
        code = own @ powers
        for move in _moves(len(dims)):
            at = np.flatnonzero(move)
            near = own[:, at] + move[at]
            ok = ((near >= 0) & (near <= segment_bits)).all(axis=1)
            who.append(np.flatnonzero(ok))
            what.append((code[ok] + int(move @ powers)) * parts + part)
    return np.concatenate(who), np.concatenate(what)


def split_cells(who: np.ndarray, what: np.ndarray, fps: np.ndarray, large: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As ``who`` and ``what``, with large cells replaced by groups of two blocks each.

    large: cells in order, and the blocks that each has. A fingerprint is in one block, and
    so in as many groups as there are blocks. Groups are named by a hash; those that share a
    name are only compared together.
    """
    cell, blocks = large
    if not len(cell):
        return who, what
    at = np.minimum(np.searchsorted(cell, what), len(cell) - 1)
    is_large = cell[at] == what
    w, c, g = who[is_large], what[is_large].astype(np.uint64), blocks[at[is_large]]
    own = (fps[w] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % g
    of = np.repeat(np.arange(len(w)), g)
    other = np.arange(len(of)) - np.repeat(np.cumsum(g) - g, g)
    low, high = np.minimum(own[of], other), np.maximum(own[of], other)
    name = (c[of] * np.uint64(0xBF58476D1CE4E5B9) ^ (low * (1 << 20) + high).astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    name ^= name >> np.uint64(29)
    return np.concatenate([who[~is_large], w[of]]), np.concatenate([what[~is_large], name.view(np.int64)])


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index in each of n points' component, for links in blocks."""
    label = np.arange(n)
    for u, v in links:
        while True:
            a, b = label[u], label[v]
            if not (different := a != b).any():
                break
            low, high = np.minimum(a, b)[different], np.maximum(a, b)[different]
            np.minimum.at(label, high, low)
            while (label != label[label]).any():
                label = label[label]
    return label


def _cell_links(cell: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each cell; the cells lie in order."""
    n = len(cell)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, n])
    a, b = [], []
    small = np.repeat(sizes <= 32, sizes)
    at = np.flatnonzero(small)
    for lag in range(1, 32):
        at = at[at < n - lag]
        at = at[cell[at] == cell[at + lag]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= max_bits]
        a.append(fps[near])
        b.append(fps[near + lag])
    for start, size in zip(first[sizes > 32], sizes[sizes > 32]):
        own = np.unique(fps[start : start + size])
        step = max(1, 4_000_000 // len(own))

        def blocks(own=own, step=step) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i in range(0, len(own), step):
                u, v = np.nonzero(np.bitwise_count(own[i : i + step, None] ^ own[None, i:]) <= max_bits)
                ok = v > u
                yield u[ok] + i, v[ok] + i

        label = _forest(len(own), blocks())
        linked = np.flatnonzero(label != np.arange(len(own)))
        a.append(own[label[linked]])
        b.append(own[linked])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(fps: DataFrame, column: str, max_bits: int, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """(a, b) among the distinct fingerprints of ``column``, within ``max_bits``.

    Not every pair is there, but every pair is connected through those that are.
    """

    def spread(large: tuple[np.ndarray, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy().view(np.uint64)
                for i in range(0, len(own), 10_000):
                    part = own[i : i + 10_000]
                    who, what = split_cells(*cells(part, max_bits, segment_bits), part, large)
                    yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(part[who].view(np.int64))], names=["cell", "fp"])

        return run

    none = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def large_cells() -> tuple[np.ndarray, np.ndarray]:
        few = fps.where(F.pmod(F.xxhash64(column), F.lit(_SAMPLE)) == 0).select(column).mapInArrow(spread(none), "cell long, fp long")
        counted = few.groupBy("cell").agg((F.count(F.lit(1)) * _SAMPLE).alias("n")).where(F.col("n") > BLOCK)
        rows = counted.orderBy(F.desc("n"), "cell").limit(MOST_SPLIT).toArrow()
        cell, n = rows.column("cell").to_numpy(), rows.column("n").to_numpy()
        order = np.argsort(cell)
        return cell[order], -(-n[order] // BLOCK) + 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _cell_links(cell, fp, max_bits)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cell = np.concatenate([cell, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(cell) < 200_000:
                continue
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if whole:
                yield out(cell[:whole], fp[:whole])
                cell, fp = cell[whole:], fp[whole:]
        yield out(cell, fp)

    # no cell has more than there are fingerprints
    large = large_cells() if fps.count() > BLOCK else none
    spread_out = fps.select(F.col(column)).mapInArrow(spread(large), "cell long, fp long")
    together = spread_out.repartition("cell").sortWithinPartitions("cell")
    return together.mapInArrow(meet, "a long, b long").distinct()


# -- components ---------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b).

    Each round every node points to the smallest node it sees and every edge is moved on
    to those roots; edges inside one tree vanish. Rounds grow with the logarithm of the
    longest path. Hot nodes aggregate map-side; the joins leave skew to adaptive execution.
    """
    spark = edges.sparkSession
    edges = cut(edges.where("a <> b").select("a", "b"))
    forest = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")))
        # pointers go down strictly, so halving them ends
        while True:
            on = parent.alias("p").join(parent.alias("q"), F.col("p.up") == F.col("q.node"), "left")
            jumped = cut(on.select("p.node", F.coalesce("q.up", "p.up").alias("up"), (F.coalesce("q.up", "p.up") != F.col("p.up")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            parent = jumped.select("node", "up")
            if not moved:
                break
        if forest is None:
            forest = parent
        else:
            old = forest.alias("f").join(parent.alias("p"), F.col("f.up") == F.col("p.node"), "left")
            forest = cut(old.select("f.node", F.coalesce("p.up", "f.up").alias("up")))
        at = edges.join(parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(parent.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        edges = cut(at.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    if forest is None:
        return spark.createDataFrame([], "node long, root long")
    return forest.select("node", F.col("up").alias("root"))


def _classes(df: DataFrame, id_col: str, text_col: str, width: int, max_bits: int, segment_bits: int) -> DataFrame:
    """(__id, __fp, component_id) of every row."""
    keyed = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__own"))
    own = cut(with_fingerprints(keyed, keys=["__id"], text_col="__own", width=width, name="__fp"))
    distinct = cut(own.groupBy("__fp").agg(F.min("__id").alias("low"), F.count(F.lit(1)).alias("n_rows")))
    tree = components(links(distinct, "__fp", max_bits, segment_bits))
    rooted = distinct.join(tree, distinct["__fp"] == tree["node"], "left").select("__fp", "low", "n_rows", F.coalesce("root", "__fp").alias("root"))
    rooted = cut(rooted)
    # only components of several fingerprints need to look for their smallest id
    several = rooted.groupBy(F.col("root").alias("r2")).agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = join_keys(rooted, cut(several), [F.col("root") == F.col("r2")], weight="n", how="left")
    classes = cut(classes.select(F.col("__fp").alias("f2"), "n_rows", F.coalesce("least", "low").alias("component_id")))
    return join_keys(own, classes, [F.col("__fp") == F.col("f2")], weight="n_rows", how="inner")


def near_duplicates(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4, segment_bits: int = SEGMENT_BITS
) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``df``.

    fingerprint: 16 hex digits; component_id: the smallest id among all rows reachable
    over fingerprints that differ in at most ``max_bits`` bits.

    Null and empty texts have fingerprint zero and link like others. Rows of equal id or
    text each give a row. A null id is larger than all others: a component holding only
    null ids has a null component_id. Other columns are not read.
    """
    done = _classes(df, id_col, text_col, width, max_bits, segment_bits)
    return done.select(F.col("__id").alias(id_col), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")

"""Multi-way equi-joins of any shape, cyclic ones above all, in worst-case optimal time.

Binary plans of cyclic joins can make far more rows than the result has. Here relations
are dealt once over a hypercube: each join variable has a share, a row goes to the cells
that agree with the hashes of its own variables, and every result is found in exactly
one cell. In a cell the variables are bound one after another: for each partial binding
the relation with the fewest continuations proposes, and the others are probed.

A value that is hot in one variable still spreads over the shares of the others.

Rows are dealt in packed blocks, of some 3 bytes a row where values lie close, so a copy of a
relation costs little disk. A task gets one cell of the hypercube, holds its blocks packed, and
splits it by finer shares into cells that it joins one at a time: copies on disk grow with
the tasks, of which there are few, and memory with the finer cells' rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partial bindings that a cell extends at a time.
_FRONTIER = 250_000
#: Rows that are joined at a time, about, copies included.
CELL_ROWS = 2_000_000
#: Rows for which a task is added to ``TASKS``, about.
TASK_ROWS = 16_000_000
#: Tasks at least; each doubling copies some relations once more.
TASKS = 32
#: Finer cells of a task at most.
_FINER = 4096
#: Rows packed at a time.
_PACK = 1 << 20


def shares(sizes: list[int], variables: list[list[str]], order: list[str], cells: int, *, start: dict[str, int] | None = None, rows: int | None = None) -> dict[str, int]:
    """Share of each variable, with a product of about ``cells``.

    Doubles whichever share then copies the fewest rows, from ``start`` on, and with ``rows`` only
    while a cell has more.
    """
    held = dict(start or {v: 1 for v in order})
    joined = [v for v in order if sum(v in own for own in variables) > 1]

    def product(share: dict[str, int]) -> int:
        return int(np.prod(list(share.values())))

    def copied(share: dict[str, int]) -> int:
        return sum(n * int(np.prod([share[v] for v in order if v not in own])) for n, own in zip(sizes, variables))

    while joined and product(held) * 2 <= cells and (rows is None or copied(held) > rows * product(held)):
        best = min(joined, key=lambda v: (copied({**held, v: held[v] * 2}), held[v], order.index(v)))
        held[best] *= 2
    return held


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of integers, best sorted by the first: zigzag differences as planes of bytes, compressed."""
    parts = [np.array([len(columns[0])], np.int64).tobytes()]
    for c in columns:
        step = np.diff(c, prepend=np.int64(0))
        planes = ((step << 1) ^ (step >> 63)).view(np.uint8).reshape(-1, 8).T
        used = [bool(p.any()) for p in planes]
        parts.append(np.packbits(used, bitorder="little").tobytes())
        parts += [p.tobytes() for p, some in zip(planes, used) if some]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(columns):
        used, at = raw[at], at + 1
        planes = np.zeros((n, 8), np.uint8)
        for k in range(8):
            if used >> k & 1:
                planes[:, k] = np.frombuffer(raw, np.uint8, n, at)
                at += n
        zigzag = planes.view(np.uint64)[:, 0]
        step = (zigzag >> np.uint64(1)).view(np.int64) ^ -(zigzag & np.uint64(1)).view(np.int64)
        out.append(np.cumsum(step))
    return out


class _Trie:
    """A relation's distinct rows, by variables in join order, as sorted levels.

    Level k has the keys ``parent * domain + code`` of its nodes, in order, so a child is
    found by one search, and all children of a node lie together.
    """

    def __init__(self, codes: list[np.ndarray], domains: list[int], counts: np.ndarray):
        order = np.lexsort(codes[::-1])
        self.counts = counts[order]
        self.domains = domains
        self.keys: list[np.ndarray] = []
        parent = np.zeros(len(order), np.int64)
        self.starts: list[np.ndarray] = []
        parents = 1
        for c, domain in zip(codes, domains):
            key = parent * domain + c[order]  # in order
            first = np.diff(key, prepend=-1) != 0
            self.keys.append(key[first])
            self.starts.append(np.searchsorted(self.keys[-1], np.arange(parents + 1) * domain))
            parent, parents = np.cumsum(first) - 1, len(self.keys[-1])

    def children(self, level: int, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[level][parent], self.starts[level][parent + 1]

    def child(self, level: int, parent: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, whether there is one)"""
        key = parent * self.domains[level] + code
        at = np.minimum(np.searchsorted(self.keys[level], key), len(self.keys[level]) - 1)
        return at, self.keys[level][at] == key


def join_cell(relations: list[tuple[list[str], list[np.ndarray], np.ndarray]], order: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (bindings, one column for each variable; multiplicities).

    relations: (variables, value columns, counts) with distinct rows.
    """
    if any(not len(counts) for _, _, counts in relations):
        return
    values = {v: np.unique(np.concatenate([c[own.index(v)] for own, c, _ in relations if v in own])) for v in order}
    tries, levels = [], []
    for own, columns, counts in relations:
        mine = [v for v in order if v in own]
        codes = [np.searchsorted(values[v], columns[own.index(v)]) for v in mine]
        tries.append(_Trie(codes, [len(values[v]) for v in mine], counts))
        levels.append({v: k for k, v in enumerate(mine)})

    def extend(depth: int, bound: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """bound: codes so far; nodes: each relation's node for each binding."""
        if depth == len(order):
            multiplicity = np.ones(len(bound), np.int64)
            for r, t in enumerate(tries):
                multiplicity *= t.counts[nodes[:, r]]
            yield np.stack([values[v][bound[:, k]] for k, v in enumerate(order)], axis=1), multiplicity
            return
        v = order[depth]
        holders = [r for r in range(len(tries)) if v in levels[r]]
        spans = [tries[r].children(levels[r][v], nodes[:, r]) for r in holders]
        fewest = np.argmin(np.stack([high - low for low, high in spans]), axis=0)
        for k, r in enumerate(holders):
            at = np.flatnonzero(fewest == k)
            low, high = spans[k][0][at], spans[k][1][at]
            sizes = high - low
            ends = np.cumsum(sizes)
            start = 0
            while start < len(at):
                # as many bindings as fit; one is never split
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + _FRONTIER, side="right")))
                n = sizes[start:stop]
                which = np.repeat(np.arange(start, stop), n)
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                node = low[which] + offset
                code = tries[r].keys[levels[r][v]][node] % len(values[v])
                rows = at[which]
                there = nodes[rows]
                there[:, r] = node
                keep = np.ones(len(rows), bool)
                for other in holders:
                    if other != r:
                        found, ok = tries[other].child(levels[other][v], nodes[rows, other], code)
                        there[:, other] = found
                        keep &= ok
                if keep.any():
                    yield from extend(depth + 1, np.concatenate([bound[rows[keep]], code[keep, None]], axis=1), there[keep])
                start = stop

    yield from extend(0, np.zeros((1, 0), np.int64), np.zeros((1, len(tries)), np.int64))


def _packer(columns: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (cell, bucket, ``columns`` more) as one packed block for each cell and bucket, some rows at a time."""

    def packed(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column(0).to_numpy() * buckets + rows.column(1).to_numpy()
        values = [rows.column(2 + k).to_numpy() for k in range(columns)]
        order = np.lexsort([*values[::-1], key])
        key, values = key[order], [v[order] for v in values]
        cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        first = key[cuts[:-1]]
        blobs = [pack([v[low:high] for v in values]) for low, high in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(first // buckets), pa.array(first % buckets), pa.array(blobs, pa.binary())], names=["cell", "bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _PACK:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    return run


def _kernel(variables: list[list[str]], order: list[str], finer: dict[str, int], count_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins cell after cell of packed blocks that lie in order of their cells; results go out block by block.

    finer: how many parts each variable's share has in a cell; a relation's ``bucket`` has its
    variables' parts as digits.
    """

    def join(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[int, int], list] = {}
        for batch in held:
            for rel, bucket, block in zip(*(batch.column(c) for c in ("rel", "bucket", "block"))):
                blocks.setdefault((rel.as_py(), bucket.as_py()), []).append(block)
        total = 0
        for part in np.ndindex(*(finer[v] for v in order)):
            at = dict(zip(order, part))
            mine = []
            for r, own in enumerate(variables):
                bucket = 0
                for v in own:
                    bucket = bucket * finer[v] + int(at[v])
                mine.append(blocks.get((r, bucket), []))
            if not all(mine):
                continue
            relations = []
            for own, some in zip(variables, mine):
                unpacked = [unpack(b.as_buffer().to_pybytes(), len(own) + 1) for b in some]
                *columns, counts = [np.concatenate(c) for c in zip(*unpacked)]
                relations.append((own, columns, counts))
            for found, m in join_cell(relations, order):
                if count_only:
                    total += int(m.sum())
                else:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(order))), pa.array(m)], names=[*order, "multiplicity"])
        if count_only:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["multiplicity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for low, high in zip(cuts, cuts[1:]):
                if held and high > low and held[-1].column("cell")[0].as_py() != cell[low]:
                    yield from join(held)
                    held = []
                if high > low:
                    held.append(batch.slice(low, high - low))
        if held:
            yield from join(held)

    return run


def multiway_join(relations: list[tuple[DataFrame, list[str]]], *, cells: int | None = None, sizes: list[int] | None = None, count_only: bool = False) -> DataFrame:
    """Natural join of all ``relations`` on equally named variables.

    relations: (rows, names for its columns in order); the columns are integers, others are
    refused, and rows with a null never join. Gives each distinct binding of all variables with its
    ``multiplicity``, the number of combinations of rows that make it; with ``count_only``
    only partial sums of ``multiplicity``.

    sizes: about how many rows the relations have, which sets the shares and nothing else;
    they are counted if not given, which computes relations that are not stored once more.
    A task holds the input of one of ``cells``, packed; by default they are ``TASKS``, or one for each
    core, or for about ``TASK_ROWS`` rows, were none copied, whatever is most. It joins about
    ``CELL_ROWS`` of its rows at a time.
    """
    spark = relations[0][0].sparkSession
    sizes = sizes or [df.count() for df, _ in relations]
    cells = cells or max(TASKS, spark.sparkContext.defaultParallelism, -(-sum(sizes) // TASK_ROWS))
    variables = [own for _, own in relations]
    grouped = []
    for df, own in relations:
        if len(own) != len(df.columns) or len(set(own)) != len(own):
            raise ValueError("each column of a relation needs a name of its own")
        if odd := [f.name for f in df.schema if not isinstance(f.dataType, T.IntegralType)]:
            raise TypeError(f"columns that are no integers: {odd}")
        cast = df.select(*(F.col(f"`{c}`").cast("long").alias(v) for c, v in zip(df.columns, own))).dropna()
        grouped.append(cast.groupBy(*own).agg(F.count(F.lit(1)).alias("m")))
    names = list(dict.fromkeys(v for own in variables for v in own))
    order: list[str] = []
    while len(order) < len(names):
        # connected to what is bound, then in most relations
        rest = [v for v in names if v not in order]
        near = [v for v in rest if any(v in own and set(own) & set(order) for own in variables)] or rest
        order.append(max(near, key=lambda v: (sum(v in own for own in variables), -names.index(v))))
    held = shares(sizes, variables, order, cells)
    fine = shares(sizes, variables, order, _FINER * int(np.prod(list(held.values()))), start=held, rows=CELL_ROWS)
    finer = {v: fine[v] // held[v] for v in order}
    weight, w = {}, 1
    for v in order:
        weight[v] = w
        w *= held[v]
    dealt = None
    for r, (df, own) in enumerate(zip(grouped, variables)):
        cell: Column = F.lit(0).cast("long")
        bucket: Column = F.lit(0).cast("long")
        for v in own:
            part = F.pmod(F.xxhash64(v), F.lit(fine[v]))
            cell = cell + part % held[v] * weight[v]
            bucket = bucket * finer[v] + (part / held[v]).cast("long")
        rows = df.select(cell.alias("cell"), bucket.alias("bucket"), *own, "m")
        rows = rows.mapInArrow(_packer(len(own) + 1, int(np.prod([finer[v] for v in own]))), "cell long, bucket long, block binary")
        for v in order:
            if v not in own and held[v] > 1:
                rows = rows.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(held[v] - 1)))).withColumn("cell", F.col("cell") + F.col("__p") * weight[v]).drop("__p")
        rows = rows.select("cell", F.lit(r).alias("rel"), "bucket", "block")
        dealt = rows if dealt is None else dealt.unionByName(rows)
    schema = "multiplicity long" if count_only else ", ".join([*(f"{v} long" for v in order), "multiplicity long"])
    return dealt.repartitionById(w, F.col("cell").cast("int")).sortWithinPartitions("cell").mapInArrow(_kernel(variables, order, finer, count_only), schema)

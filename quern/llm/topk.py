"""Exact top-k inner-product search (operator 6).

Method: Fagin's threshold algorithm. A block of vectors has, for each dimension, the list
of its vectors by falling component. A query reads the lists in parallel, from the top
where its own component is positive and from the bottom where it is negative, and scores
every vector it meets in full. No unmet vector can score more than the components at the
lists' current depth allow; when that bound is below the k-th best score so far, it stops.

Scale: vectors and queries are dealt into blocks of bounded size by a hash of the id, and
each pair of a query block and a vector block is one group; a block's k best per query
go on, and a window over these picks the final ones. What is shuffled is the vectors
once per query block and the queries once per vector block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block of vectors, at least and at most, and of queries at most.
LEAST_BLOCK, MOST_BLOCK, QUERY_BLOCK = 1024, 65_536, 65_536
#: Lists are read so deep first, then twice as deep each time.
FIRST_DEPTH = 16


def quantised(vectors: list[np.ndarray] | np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers: int64, or Python's where those could overflow."""
    m = np.floor(scale * np.asarray(vectors, np.float64))
    if m.size and np.abs(m).max() >= 2.0**24:
        return np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return m.astype(np.int64)


class Block:
    """Vectors with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        #: queries, and the vectors that they have met
        self.asked = self.met = 0
        self.lists = np.argsort(-self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.lists, axis=0)

    def best(self, query: np.ndarray, own_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best others: by falling score, then rising id."""
        n = len(self.ids)
        dims = np.flatnonzero(query != 0)
        seen = np.zeros(n, bool)
        at, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        up = query[dims] > 0
        depth, more = 0, FIRST_DEPTH
        while depth < n:
            to = min(n, depth + more)
            rows = np.arange(depth, to)
            place = np.where(up[None, :], rows[:, None], n - 1 - rows[:, None])
            met = self.lists[place, dims[None, :]].ravel() if len(dims) else np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            new = new[self.ids[new] != own_id]
            at = np.concatenate([at, new])
            scores = np.concatenate([scores, self.vectors[new] @ query])
            if len(at) > k:
                keep = np.lexsort((self.ids[at], -scores))[:k]
                at, scores = at[keep], scores[keep]
            if not len(dims) or seen.all():
                break
            bound = (self.values[place[-1], dims] * query[dims]).sum()
            if len(at) == k and bound < scores.min():
                break
            depth, more = to, 2 * more
        self.asked, self.met = self.asked + 1, self.met + int(seen.sum())
        keep = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[keep]], scores[keep]


def _distinct(ids: np.ndarray, vectors: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeated rows of equal id and vector, as given."""
    if len(np.unique(ids)) == len(ids):
        return ids, vectors
    first: dict[tuple, int] = {}
    for i, (d, v) in enumerate(zip(ids.tolist(), raw.tolist())):
        first.setdefault((d, *v), i)
    keep = list(first.values())
    return ids[keep], vectors[keep]


def _searcher(k: int, scale: float) -> Callable[[pa.Table], pa.Table]:
    def search(group: pa.Table) -> pa.Table:
        asked = group.column("is_query").to_numpy()
        ids = group.column("id").to_numpy()
        lists = group.column("vec").combine_chunks()
        dim = group.column("dim")[0].as_py()
        raw = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        vectors = quantised(raw, scale)
        own = _distinct(ids[~asked], vectors[~asked], raw[~asked])
        nth = group.column("nth").to_numpy()
        out: list[list] = [[], [], [], []]
        if len(own[0]):
            block = Block(*own)
            for d, i, q in zip(ids[asked], nth[asked], vectors[asked]):
                found, scores = block.best(q, d, k)
                if len(scores) and max(abs(int(s)) for s in scores) >= 2**63:
                    raise OverflowError(f"a score of query {d} is beyond a long")
                for column, x in zip(out, ([int(d)] * len(found), [int(i)] * len(found), found.tolist(), [int(s) for s in scores])):
                    column += x
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "nth", "vec_id", "score"), out)})

    return search


def top_k(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best others, all if fewer.

    ``is_query`` tells the rows that ask; all rows can answer. Score: inner product of the
    vectors' components turned into floor(scale * x), an integer; equal scores rank by
    smaller id. Rows of null id, and of null vectors or ones with null or non-finite
    components, take no part. Vectors answer queries of their own length. Repeated rows
    of equal id and vector count once; rows of a query's own id never answer it, and rows of
    equal id and other vectors are queries of their own. A result's score beyond a long
    fails the query. Other columns are not read; an empty table, or one without queries,
    gives an empty result.
    """
    spark = df.sparkSession
    vec = F.col("vec")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), is_query.alias("is_query"))
    rows = rows.where(F.col("id").isNotNull() & vec.isNotNull() & F.forall(vec, number)).withColumn("dim", F.size("vec"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    size = min(MOST_BLOCK, max(LEAST_BLOCK, n // (4 * spark.sparkContext.defaultParallelism)))
    blocks, asks = max(1, -(-n // size)), max(1, -(-asked // QUERY_BLOCK))

    def part(salt: int, of: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(of)).cast("int")

    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    answers = rows.select("id", F.lit(0).alias("nth"), "vec", "dim", F.lit(False).alias("is_query"), part(1, blocks).alias("block"), every(asks).alias("ask"))
    # the different vectors of an id are numbered
    asking = rows.where("is_query").select("id", "vec", "dim").distinct().withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("vec")))
    queries = asking.select("id", "nth", "vec", "dim", F.lit(True).alias("is_query"), part(2, asks).alias("ask"), every(blocks).alias("block"))
    cells = answers.unionByName(queries).groupBy("dim", "block", "ask")
    best = cells.applyInArrow(_searcher(k, scale), "query_id long, nth long, vec_id long, score long")
    order = W.partitionBy("query_id", "nth").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

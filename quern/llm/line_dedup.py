"""Line deduplication (operator 5), DataFrame functions only.

Method: hashes of lines are kept as levelled sorted runs. A new batch is merge-anti-joined
with the runs: lines that no run has seen are new, and their largest document keeps them;
all of the batch's lines then become a run of their own. When a level holds ``fanout``
runs, they are merged into one run of the next level. Batches come by falling document
id, so the first batch that holds a line has the document that keeps it, and later ones
only add to the line's count.

Runs are tables bucketed by hash in the shared folder, one sorted file for each bucket: the
anti-join and the compaction merge them side by side without an exchange or a sort. Only
hashes (128 bits), ids and positions move; texts are read twice. The lines to drop are
broadcast where they take ``BROADCAST_BYTES`` at most; beyond, texts are shuffled to them once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CHARS, ascii_lower, cut, drop_path, fresh_path, join_keys, let

KEY = ["h1", "h2"]
#: Positions of lines to drop that are broadcast, at most, with what their rows take.
BROADCAST_BYTES = 32 << 20
#: By default scans of bucketed tables don't tell that their files are sorted.
_SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Bucketed scans of one file a bucket report their order to what is planned within."""
    before = spark.conf.get(_SORTED_SCANS, None)
    spark.conf.set(_SORTED_SCANS, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SORTED_SCANS) if before is None else spark.conf.set(_SORTED_SCANS, before)


def text_lines(text: Column) -> Column:
    """The text split at newlines; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of every line: stripped of ASCII white space, A-Z lower-cased."""
    return F.transform(text_lines(ascii_lower(text)), lambda x: F.btrim(x, F.lit(WS_CHARS)))


def row_key(text: Column) -> Column:
    """Tells rows of equal id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(df: DataFrame, *, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row, pos, h1, h2) of every line whose key has ``min_chars`` code points."""
    keys = F.transform(line_keys(F.col(text_col)), lambda x, i: F.struct(i.alias("pos"), x.alias("key")))
    long = F.filter(keys, lambda x: F.length(x["key"]) >= min_chars)
    # hashed before the explode, so that no line leaves its row
    hashed = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2")))
    return df.select(F.col(id_col).alias("id"), row_key(F.col(text_col)).alias("row"), F.inline(hashed))


class LineRuns:
    """Levelled sorted runs of line hashes: (h1, h2, n_docs, keeper).

    keeper is set where a line was new, and null where it was only counted. There are as
    many buckets as the session has shuffle partitions. Used within :func:`sorted_scans`.
    """

    def __init__(self, spark: SparkSession, *, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = fresh_path(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self._tag, self._made = uuid.uuid4().hex[:12], 0

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """Add the run of a batch of (h1, h2, id) rows.

        Rows of equal hash and id count once. A null id is one document, which keeps no line.
        """
        docs = batch.select(*KEY, "id").distinct()
        own = docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
        # grouped by the buckets' own hash: a bucket's rows are in one task, which writes one file
        stored = self._store(own)
        if self.runs():
            own = new = self.spark.table(stored)
            for run in self.runs():
                # both sides are bucketed and sorted: a merge without exchange
                new = new.hint("merge").join(self.spark.table(run).select(*KEY), KEY, "left_anti")
            marked = own.hint("merge").join(new.select(*KEY, F.lit(True).alias("new")), KEY, "left")
            old, stored = stored, self._store(marked.select(*KEY, "n_docs", F.when(F.col("new"), F.col("keeper")).alias("keeper")))
            self._drop(old)
        self.levels[0].append(stored)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge all runs of a level into one run of the next."""
        if level + 1 == len(self.levels):
            self.levels.append([])
        old, self.levels[level] = self.levels[level], []
        self.levels[level + 1].append(self._store(self._merged(old)))
        for run in old:
            self._drop(run)

    def _merged(self, runs: list[str]) -> DataFrame:
        """One row for each hash: counts added, and the one keeper.

        A full outer merge of runs that are bucketed alike needs no exchange.
        """
        out = self.spark.table(runs[0])
        for run in runs[1:]:
            b = self.spark.table(run).select(*KEY, F.col("n_docs").alias("n2"), F.col("keeper").alias("k2"))
            out = out.hint("merge").join(b, KEY, "full").select(
                *KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n_docs"), F.greatest("keeper", "k2").alias("keeper")
            )
        return out

    def merged(self) -> DataFrame | None:
        """All runs as one, or None where nothing was added."""
        return self._merged(self.runs()) if self.runs() else None

    def _store(self, df: DataFrame) -> str:
        """Write rows that are partitioned like the buckets; gives the table's name."""
        self._made += 1
        name = f"quern_run_{self._tag}_{self._made}"
        (df.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").saveAsTable(name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        drop_path(self.spark, self.root)


def dropped_lines(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """(id, row, positions): the lines each document loses, counted from 0.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses
    all its lines except in the largest id holding it. Rows of equal id are one document:
    they count once and keep or lose a line alike. Rows of null id are one document that
    keeps no line shared with others. Only rows that lose something are returned.
    """
    spark = df.sparkSession
    cuts = df.agg(F.percentile_approx(id_col, [(batches - k) / batches for k in range(1, batches)], 1000).alias("c")).first()["c"] or []
    batch = F.lit(0)
    for k, least in enumerate(cuts):
        batch = F.when(F.col("id") < least, k + 1).otherwise(batch)
    batch = F.when(F.col("id").isNull(), F.lit(batches - 1)).otherwise(batch)
    path = fresh_path(spark, "line-signatures")
    runs = LineRuns(spark, fanout=fanout)
    try:
        found = signatures(df, id_col=id_col, text_col=text_col, min_chars=min_chars)
        found.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
        stored = spark.read.schema(found.schema.add("batch", "integer")).parquet(path)
        with sorted_scans(spark):
            for k in range(batches):
                runs.add(stored.where(F.col("batch") == k).select(*KEY, "id"))
            frequent = cut(runs.merged().where(F.col("n_docs") >= min_docs).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "keeper", "n_docs"))
        same = [F.col("h1") == F.col("f1"), F.col("h2") == F.col("f2")]
        hits = join_keys(stored.select("id", "row", "pos", *KEY), frequent, same, weight="n_docs", how="inner").where(~F.col("id").eqNullSafe(F.col("keeper")))
        return cut(hits.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("positions")))
    finally:
        runs.close()
        drop_path(spark, path)


def kept_text(text: Column, positions: Column) -> Column:
    """The text without the lines at ``positions``; null positions drop none."""

    def without(x: Column) -> Column:
        rest = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return F.array_join(F.transform(rest, lambda i: F.get(x["lines"], i)), "\n")

    whole = F.coalesce(text, F.lit(""))
    return F.when(positions.isNull(), whole).otherwise(let(F.struct(text_lines(text).alias("lines"), positions.alias("gone")), without))


def dedup_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Every row of ``df`` with ``__n_lines``, ``__n_dropped`` and ``__kept_text``.

    Null and empty texts have one empty line, which stays. All columns of ``df`` stay;
    names that begin with two underscores are this module's own.
    Options as for :func:`dropped_lines`.
    """
    gone = dropped_lines(df, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("positions").alias("__gone"))
    if (gone.agg(F.sum(F.size("__gone") * 4 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    text = F.col(text_col)
    joined = df.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (row_key(text) == F.col("__row")), "left")
    n_lines = F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), "\n", "")) + 1
    return joined.select(
        *(df[c] for c in df.columns),
        n_lines.cast("long").alias("__n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("__n_dropped"),
        kept_text(text, F.col("__gone")).alias("__kept_text"),
    )

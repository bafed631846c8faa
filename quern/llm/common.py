"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts name it: [\x20\x09-\x0D].
WS_CHARS = " \t\n\x0b\x0c\r"
#: A maximal run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Catalyst may inline a projected column into a lambda that then evaluates it for
    every element; binding it as the element of a one-element array prevents that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements of an array that :func:`running` goes through at a time.
_RUN = 256


def running(values: Column, op: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """Running values of an associative ``op`` over an array without nulls.

    ``aggregate`` copies its state at every element, so gathering n outputs would take n
    squared; here it gathers ``_RUN`` at a time, and the runs' totals are combined alike.
    """

    def short(a: Column) -> Column:
        start = F.slice(a, 1, 1)
        return F.aggregate(F.slice(a, 2, F.size(a)), start, lambda out, x: F.array_append(out, op(F.element_at(out, -1), x)))

    def long(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(a), F.lit(_RUN))
        runs = F.transform(starts, lambda i: short(F.slice(a, i, _RUN)))

        def joined(runs: Column) -> Column:
            totals = running(F.transform(runs, lambda r: F.element_at(r, -1)), op, levels - 1)

            def shifted(totals: Column) -> Column:
                return F.flatten(F.transform(runs, lambda r, k: F.when(k == 0, r).otherwise(F.transform(r, lambda x: op(F.get(totals, k - 1), x)))))

            return let(totals, shifted)

        return let(runs, joined)

    if not levels:
        return short(values)
    return let(values, lambda a: F.when(F.size(a) <= _RUN, short(a)).otherwise(long(a)))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays (``lower`` would change more)."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine is a local folder set.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not configured and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    if configured:
        return configured.rstrip("/")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_root(spark)}/quern-{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: What :func:`with_keys` adds. No key is null, so that joins and windows deal rows alike.
ROW_KEY = ["__id", "__no_id", "__row"]


def none_of(df: DataFrame, column: str) -> Column:
    """A value of the column's type that stands for null beside a flag."""
    return F.lit(0).cast(df.schema[column].dataType)


def with_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with its id, whether that is null, and the hash of its text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select("*", F.coalesce(F.col(id_col), none_of(df, id_col)).alias("__id"), F.col(id_col).isNull().alias("__no_id"), F.xxhash64(text).alias("__row"))


#: Keys that are broadcast, at most.
BROADCAST_KEYS = 100_000


def join_keys(df: DataFrame, keyed: DataFrame, on: list[Column], *, weight: str, how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` joined (inner or left) to ``keyed``, whose keys ``on`` are unique, without a hot task.

    weight: column of ``keyed``, the rows of ``df`` with the key. Up to ``most`` keys are
    broadcast. Of more, only those that have over 1 / ``most`` of all weight, of which there
    are fewer than ``most``, are; the rest are joined by a shuffle in which no key is hot.
    ``keyed`` is read several times, so it should be cut; its rows should be of bounded size.
    """
    n, total = keyed.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if n <= most:
        return df.join(F.broadcast(keyed), on, how)
    hot = F.col(weight) * most > F.lit(total)
    few = F.broadcast(keyed.where(hot))
    return df.join(few, on, "inner").unionByName(df.join(few, on, "left_anti").join(keyed.where(~hot), on, how))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)

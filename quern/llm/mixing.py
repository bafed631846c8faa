"""Mixing sources to target weights (operator 1), DataFrame functions only.

Method: the mix is a number of equal blocks of tokens. Sainte-Laguë apportionment gives
blocks to sources by highest quotient, target / (k - 1/2) for a source's k-th block, and a
source's blocks to its shards alike, by size. A shard lays its documents end to end in a
seeded order and takes its quota as one circular run of blocks from a seeded start; a
quota beyond the shard's blocks takes all of them once more. So almost every document is
taken whole, and no part of one more often than the target allows.

Scale: apportionment enumerates only the quotients near the cut, about two for each party,
however many blocks there are. Documents are dealt by (source, cell): a hot source
spreads over ``CELLS`` cells. Per source there is one row of at most ``CELLS`` numbers,
and only these rows, one for each source, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW_KEY, WORD, cut, let, none_of, with_keys

#: Finest parts of a source, and so the most shards that it can have.
CELLS = 1024
#: Blocks that the target of the smallest source has at least, if it has so many words.
BLOCKS = 64
WEIGHTS = (5.0, 2.0, 1.0)


def sainte_lague(parties: Column, seats: Column) -> Column:
    """Seats of each party, as an array like ``parties`` of (id, votes).

    id: distinct longs; they break ties, smaller first. With d = votes / seats a party
    has about votes / d seats; d is off by so little that only the seats between
    seats - n and seats + n, for n parties, can fall on either side of the cut. Those are
    enumerated and the highest quotients win. Parties without votes get none.
    """

    def within(x: Column) -> Column:
        votes, seats, n = x["votes"], x["seats"], F.size(x["parties"]).cast("double")

        def rounded(v: Column, total: Column) -> Column:
            return F.when(votes > 0, F.floor(v * F.greatest(total, F.lit(0.0)) / votes + 0.5)).otherwise(F.lit(0)).cast("long")

        def low(p: Column) -> Column:
            return F.greatest(rounded(p["votes"], seats - n - 1) - 1, F.lit(0)).cast("long")

        def quotients(p: Column) -> Column:
            ks = F.when(p["votes"] > 0, F.sequence(low(p) + 1, rounded(p["votes"], seats + n + 1) + 1)).otherwise(F.array().cast("array<bigint>"))
            return F.transform(ks, lambda k: F.struct((-p["votes"] / (k - 0.5)).alias("q"), p["id"].alias("id"), k.alias("k")))

        spare = seats.cast("long") - F.aggregate(x["parties"], F.lit(0).cast("long"), lambda a, p: a + low(p))

        def counted(y: Column) -> Column:
            last = F.get(y["all"], F.least(y["spare"], F.size(y["all"])).cast("int") - 1)
            won = lambda p: F.when(
                y["spare"] > 0, F.size(F.filter(quotients(p), lambda q: q <= last))
            ).otherwise(F.lit(0))
            return F.transform(x["parties"], lambda p: (low(p) + won(p)).cast("long"))

        return let(F.struct(F.array_sort(F.flatten(F.transform(x["parties"], quotients))).alias("all"), spare.alias("spare")), counted)

    votes = F.aggregate(parties, F.lit(0.0), lambda a, p: a + p["votes"])
    return let(F.struct(parties.alias("parties"), votes.alias("votes"), seats.cast("double").alias("seats")), within)


def targets(sources: DataFrame, *, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """``sources`` (source, source_size) with ``rank`` by code point and ``target``.

    ``share`` of all sizes is dealt by weight; a target stops at ``most`` times its
    source's size and the excess goes to the others by weight. That is one level that
    all targets per weight rise to unless they stop before; with sources in the order
    in which they stop, the level is the largest that any prefix leaves.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name).cast("long"))
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    whole = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.partitionBy(F.lit(1)).orderBy(F.col("most") / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    pool = F.sum("source_size").over(whole) * F.lit(float(share))
    none = F.lit(0.0)
    left = (pool - F.coalesce(F.sum("most").over(before), none)) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), none))
    level = ranked.withColumn("level", left)
    return level.withColumn("target", F.least("most", F.col("w") * F.max("level").over(whole))).select("source", "source_size", "rank", "target")


def mix(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    block: int = 32,
    shard_tokens: int = 8192,
    seed: int = 17,
) -> DataFrame:
    """One row for each row of ``df``: its id, source and text hash with the mix's choice.

    Columns: ``id``, ``source``, ``row`` (hash of the text), ``size`` (words), ``source_size``,
    ``target`` (of the source), ``copies`` (times the whole text is taken), ``extra_from`` and
    ``extra_to`` (words taken once more, from 0, end exclusive; the circular run can
    wrap, then also ``wrap_to``: words before it, from 0), and ``taken`` (words).

    weights: repeating, for sources by code point, null last; block: its most words, fewer
    where a source is so small that its target would be missed. Null texts have size 0, and
    rows of size 0 take nothing. Rows of equal id and text are interchangeable and each
    count. An empty table gives an empty result. Reruns give the same mix.
    """
    text = F.col(text_col)
    slim = df.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    cell = F.pmod(F.xxhash64(F.lit(seed), "id", "row"), F.lit(CELLS)).cast("int")
    slim = cut(slim.withColumn("cell", cell))

    cells = slim.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    sources = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"), F.collect_list(F.struct("cell", "cell_size")).alias("cells"))
    goals = targets(sources.select("source", "source_size"), share=share, most=most, weights=weights)
    # small enough for the smallest source to come near its target
    fine = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))) / BLOCKS))).cast("int")
    seats = goals.agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("id"), F.col("target").alias("votes")))).alias("p"), F.sum("target").alias("t"), F.coalesce(fine, F.lit(block)).alias("block"))
    won = seats.select("p", "block", sainte_lague(F.col("p"), F.round(F.col("t") / F.col("block"))).alias("s")).select("block", F.explode(F.arrays_zip("p", "s")).alias("x"))
    won = won.select(F.col("x.p.id").alias("rank"), F.col("x.s").alias("blocks"), "block")
    plan = cut(goals.join(won, "rank").join(sources.select(F.col("source").alias("s2"), "cells"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))

    shards = F.greatest(F.lit(1), F.least(F.lit(CELLS), F.ceil(F.col("source_size") / shard_tokens))).cast("int")
    dealt = plan.withColumn("shards", shards).select("*", F.inline("cells")).withColumn("shard", F.pmod("cell", F.col("shards")).cast("long"))
    shard = dealt.groupBy("rank", "shard").agg(F.sum("cell_size").alias("shard_size"))
    parts = shard.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct(F.col("shard").alias("id"), F.col("shard_size").cast("double").alias("votes")))).alias("p"))
    quota = parts.join(plan.select("rank", "blocks"), "rank").select("rank", F.explode(F.arrays_zip("p", sainte_lague(F.col("p"), F.col("blocks")).alias("s"))).alias("x"))
    quota = quota.select("rank", F.col("x.p.id").alias("shard"), F.col("x.p.votes").cast("long").alias("shard_size"), F.col("x.s").alias("quota"))
    where = dealt.select("rank", "source", "source_size", "target", "block", "cell", "shard").join(quota, ["rank", "shard"])
    where = where.withColumnRenamed("source", "s2").withColumnRenamed("cell", "c2")

    docs = slim.join(where, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cell") == F.col("c2")))
    order = W.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id", "row"), "id", "row", "size").rowsBetween(W.unboundedPreceding, 0)
    docs = docs.withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
    # the last of a shard's blocks also has what is left over
    n = F.greatest(F.lit(1), F.floor(F.col("shard_size") / F.col("block"))).cast("long")
    docs = docs.withColumn("n", n).withColumn("quota", F.least("quota", (F.col("n") * F.lit(float(most))).cast("long")))
    docs = docs.withColumn("copies", F.floor(F.col("quota") / F.col("n")).cast("long")).withColumn("run", F.col("quota") - F.col("copies") * F.col("n"))
    docs = docs.withColumn("first", F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), F.col("n")))

    def edge(b: Column) -> Column:
        return F.when(b >= F.col("n"), F.col("shard_size")).otherwise(b * F.col("block"))

    def inside(p: Column) -> Column:
        return F.least(F.greatest(p - F.col("start"), F.lit(0)), F.col("size"))

    docs = docs.withColumn("extra_from", inside(edge(F.col("first")))).withColumn("extra_to", inside(edge(F.col("first") + F.col("run"))))
    docs = docs.withColumn("wrap_to", inside(edge(F.greatest(F.col("first") + F.col("run") - F.col("n"), F.lit(0)))))
    taken = F.col("copies") * F.col("size") + F.col("extra_to") - F.col("extra_from") + F.col("wrap_to")
    return docs.select("id", "source", "row", "size", "source_size", "target", "copies", "extra_from", "extra_to", "wrap_to", taken.cast("long").alias("taken"))


def mixed_rows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of ``df``, a row for each time a text is taken.

    Whole texts stay as they are; a text that a run of blocks cuts has the words on the
    run's side of the cut, joined by spaces. Rows that the mix takes nothing of go.
    """
    plan = mix(df, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = ["size", "copies", "extra_from", "extra_to", "wrap_to"]
    key = [F.coalesce("id", none_of(df, id_col)).alias("__id"), F.col("id").isNull().alias("__no_id"), F.col("row").alias("__row")]
    of_source = lambda c: (F.coalesce(c, none_of(df, source_col)).alias("__source"), F.col(c).isNull().alias("__no_source"))
    keys = [*ROW_KEY, "__source", "__no_source"]
    chosen = plan.where("taken > 0").groupBy(*key, *of_source("source")).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("__parts"))
    rows = with_keys(df, id_col, text_col).select("*", *of_source(source_col)).join(chosen, keys)
    # rows of equal id, text and source differ only in what they take; the join has dealt and sorted them
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("__row"))
    both = rows.withColumn("__c", F.get("__parts", nth - 1)).where("__c IS NOT NULL")

    def words(low: Column, high: Column) -> Column:
        part = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), (low + 1).cast("int"), (high - low).cast("int"))
        return F.when((low == 0) & (high == F.col("__c.size")), text).otherwise(F.array_join(part, " "))

    pieces = [
        F.array_repeat(F.struct(F.lit(0).cast("long").alias("low"), F.col("__c.size").alias("high")), F.col("__c.copies").cast("int")),
        F.array(F.struct(F.col("__c.extra_from").alias("low"), F.col("__c.extra_to").alias("high"))),
        F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("__c.wrap_to").alias("high"))),
    ]
    some = F.filter(F.concat(*pieces), lambda p: p["high"] > p["low"])
    made = both.select(*df.columns, "__c", F.explode(some).alias("__piece"))
    return made.withColumn(text_col, words(F.col("__piece.low"), F.col("__piece.high"))).select(*df.columns)

"""Joins beyond ``DataFrame.join``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def semi_join(left: DataFrame, right: DataFrame, on: list[str] | Column) -> DataFrame:
    """Rows of ``left`` with a partner: EXISTS, or IN."""
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, null_aware: bool = False) -> DataFrame:
    """Rows of ``left`` without a partner: NOT EXISTS, or with ``null_aware`` NOT IN.

    NOT IN holds for no row if ``right`` has a null key, for all if it is empty, and
    otherwise for rows whose key is not null and not there.
    """
    if not null_aware:
        return left.join(right, F.col(left_key) == F.col(right_key), "left_anti")
    keys = right.select(F.col(right_key).alias("__key"))
    # one row, whatever the input: how NOT IN treats the whole set
    facts = keys.agg(F.count(F.lit(1)).alias("__n"), F.count("__key").alias("__known"))
    out = left.join(keys.where("__key IS NOT NULL"), F.col(left_key) == F.col("__key"), "left_anti").crossJoin(F.broadcast(facts))
    return out.where((F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & F.col(left_key).isNotNull())).drop("__n", "__known")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An inner or left join in which each key of ``big`` spreads over ``salts`` tasks.

    For keys so hot that one task cannot take one, where adaptive execution cannot split
    it; ``small`` is repeated ``salts`` times.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted joins are inner or left")
    spread = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")


def band_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= value <= high``, value of ``left``, bounds of ``right``.

    A theta join as an equi-join on buckets of ``width``: a band goes to the buckets it
    touches, a value to its own, so no pair is tried outside its bucket.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    a = left.withColumn("__bucket", bucket(value))
    b = right.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    return a.join(b, "__bucket").where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("__bucket")

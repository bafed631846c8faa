"""Quality rules with adaptive thresholds (operator 8), DataFrame functions only.

Method: each document's measures go into quantile sketches for each language and source.
A sketch counts the values of logarithmic bins (relative error ``GAMMA`` - 1), so sketches
merge by adding counts, whatever the order of the rows, and thin groups take the merged
sketch of their language or of all documents. Fences replace fixed cutoffs: a quantile of
the sketch, and beyond it ``reach`` times its distance from the median, counted in bins and
so in ratios. Where the quantile is the median, one further out counts. Only documents that
have any of what is measured are compared in it. No fence has a value of its own. Joining
them to the documents filters.

Scale: texts are read once, in one map; after it only numbers move. Sketches are
aggregated map-side and have at most ``MOST_BINS`` bins, so no group is large anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WS_CHARS, cut, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
GAMMA = 1.002
#: Documents that a group's own sketch needs, and how far beyond its quantile a fence lies.
MIN_ROWS, REACH = 100, 6
#: Bins are counted from here to its negative; zero has one of its own below.
MOST_BINS = 8192
_ZERO = -MOST_BINS
#: Measure -> whether values can be too low, besides too high.
MEASURES = {"word_length": True, "symbols_per_word": False, "dup_line_share": False, "repeat_share": False, "echo_share": False}
#: Shares of a group beyond its quantiles, tried in this order.
TAILS = (0.25, 0.1, 0.05, 0.01)


def repeat_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that the text has twice or more.

    Windows are compared by 64-bit hashes of their words' hashes.
    """

    def count(x: Column) -> Column:
        ordered = F.array_sort(F.transform(x, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            def twice(e: Column, k: Column) -> Column:
                same = lambda j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
                return same(k - 1) | same(k + 1)

            at = F.array_sort(F.transform(F.filter(s, twice), lambda e: e["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(let(ordered, covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    hashed = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(windows(h), count))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(hashed(words))


def echoes(words: Column) -> Column:
    """Words equal to the one before."""
    return F.size(F.filter(words, lambda x, i: F.coalesce(F.get(words, i - 1) == x, F.lit(False)))).cast("long")


def measured(df: DataFrame, *, keys: list[str], text_col: str, min_words: int, repeat_percent: int) -> DataFrame:
    """``keys`` with the base counts of every whole text and ``base_failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    real = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    by_words = let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), echoes(w).alias("n_echoes")),
    )
    by_lines = let(real, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = df.select(
        *keys,
        by_words.alias("w"),
        by_lines.alias("l"),
        F.length(F.translate(text, WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select(*keys, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "w.n_echoes")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _values() -> dict[str, Column]:
    n, lines = F.col("n_words").cast("double"), F.col("n_lines").cast("double")
    return {
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
        "echo_share": F.col("n_echoes") / n,
    }


def bin_of(value: Column) -> Column:
    """The value's bin: values of one bin differ by a factor of ``GAMMA`` at most."""
    near = F.ceil(F.log(value) / F.log(F.lit(GAMMA)))
    return F.when(value <= 0, F.lit(_ZERO)).otherwise(F.greatest(F.least(near, F.lit(MOST_BINS)), F.lit(_ZERO + 1))).cast("int")


def bin_value(b: Column) -> Column:
    """The middle of a bin."""
    return F.when(b == _ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b.cast("double")) * (2 / (1 + GAMMA)))


def quantile_bin(sketch: Column, q: float) -> Column:
    """The lowest bin of the sketch that a share ``q`` of the counted values don't exceed."""

    def of(x: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("at"))

        def step(a: Column, e: Column) -> Column:
            n = a["n"] + e["n"]
            return F.struct(n.alias("n"), F.coalesce(a["at"], F.when(n >= q * x["total"], e["bin"])).alias("at"))

        return F.aggregate(x["sketch"], start, step, lambda a: a["at"])

    total = F.aggregate(sketch, F.lit(0).cast("long"), lambda a, e: a + e["n"])
    return let(F.struct(F.array_sort(sketch).alias("sketch"), total.alias("total")), of)


def sketches(measures: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, bin, n): the finest sketches, of documents that pass the base rules.

    They count the values above zero.
    """
    each = F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(v).alias("bin")) for m, v in _values().items()))
    return measures.where(~F.col("base_failed")).select(*groups, F.inline(each)).where(F.col("bin") > _ZERO).groupBy(*groups, "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def _fences(bins: DataFrame, by: list[str], reach: int) -> DataFrame:
    """(by, measure, total, low, high) of the sketches merged to ``by``; fences are bins.

    A sketch that has no tail apart from its median gives no fence.
    """
    merged = bins.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
    one = merged.groupBy(*by, "measure").agg(F.sum("n").alias("total"), F.collect_list(F.struct("bin", "n")).alias("sketch"))
    levels = {"mid": 0.5, **{f"low_{k}": t for k, t in enumerate(TAILS)}, **{f"high_{k}": 1 - t for k, t in enumerate(TAILS)}}
    one = one.withColumns({name: quantile_bin(F.col("sketch"), q) for name, q in levels.items()})

    def fence(side: str) -> Column:
        tail = F.coalesce(*(F.when(F.col(f"{side}_{k}") != F.col("mid"), F.col(f"{side}_{k}")) for k in range(len(TAILS))))
        return tail + F.lit(reach) * (tail - F.col("mid"))

    two_sided = F.col("measure").isin([m for m, both in MEASURES.items() if both])
    return one.select(*by, "measure", "total", F.when(two_sided, fence("low")).alias("low"), fence("high").alias("high"))


def thresholds(bins: DataFrame, groups: list[str], *, min_rows: int, reach: int) -> DataFrame:
    """(groups, then m_low and m_high of each measure m): the fences of every group, as bins.

    A group of fewer than ``min_rows`` documents takes the fences of the merged sketch of
    its first key (the language), and if that has fewer, of all.
    """
    own, upper, whole = _fences(bins, groups, reach), _fences(bins, groups[:1], reach), _fences(bins, [], reach)
    upper = upper.select(F.col(groups[0]).alias("__g"), F.col("measure").alias("__m"), *(F.col(c).alias(f"u_{c}") for c in ("total", "low", "high")))
    whole = whole.select(F.col("measure").alias("__w"), F.col("low").alias("w_low"), F.col("high").alias("w_high"))
    all_of = own.join(upper, F.col(groups[0]).eqNullSafe(F.col("__g")) & (F.col("measure") == F.col("__m"))).join(F.broadcast(whole), F.col("measure") == F.col("__w"))

    def chosen(side: str) -> Column:
        return F.when(F.col("total") >= min_rows, F.col(side)).when(F.col("u_total") >= min_rows, F.col(f"u_{side}")).otherwise(F.col(f"w_{side}"))

    done = all_of.select(*groups, "measure", chosen("low").alias("low"), chosen("high").alias("high"))
    sides = [F.max(F.when(F.col("measure") == m, F.col(s))).alias(f"{m}_{s}") for m in MEASURES for s in ("low", "high")]
    return done.groupBy(*groups).agg(*sides)


def judge(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 20,
    repeat_percent: int = 30,
    min_rows: int = MIN_ROWS,
    reach: int = REACH,
) -> DataFrame:
    """For every row of ``df`` its id, base counts, ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules and no measure is outside its group's
    fences. Null and empty texts have no words and fail. Null languages and sources are
    groups like others; repeated rows each count and are judged alike. Other columns are
    not read. An empty table gives an empty result.
    """
    slim = df.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), F.col(text_col).alias("__text"))
    measures = cut(measured(slim, keys=["__id", "__lang", "__source"], text_col="__text", min_words=min_words, repeat_percent=repeat_percent))
    groups = ["__lang", "__source"]
    bins = cut(sketches(measures, groups))
    limits = thresholds(bins, groups, min_rows=min_rows, reach=reach)
    limits = limits.withColumnRenamed("__lang", "__l").withColumnRenamed("__source", "__s")
    both = measures.join(limits, F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s")), "left")

    def within(m: str, v: Column) -> Column:
        outside = (bin_of(v) < F.col(f"{m}_low")) | (bin_of(v) > F.col(f"{m}_high"))
        return (v <= 0) | ~F.coalesce(outside, F.lit(False))

    inside = [within(m, v) for m, v in _values().items()]
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(reduce(lambda a, b: a & b, inside))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return both.select(F.col("__id").alias(id_col), *counts, "base_failed", kept.alias("kept"))

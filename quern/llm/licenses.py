"""Licence scans (operator 7), DataFrame functions only.

Method: ordered signature rules. One pass over a text's words finds the keywords that it
has; a rule's regex runs only where one of the rule's keywords is among them. Detections are
intervals of the text; one inside another goes if the outer one's rule has a priority at
least as high. What is left gives the labels and the score.

One map over the rows: rules are a literal of fixed size, and everything about a text
happens in its row, so there is no shuffle and no group that could be hot.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, running
from .license_rules import Rule, keyword_pattern, rules

_DETECTION = "struct<start:int,end:int,priority:int,order:int,label:string,confidence:double>"
#: Anything between words: ASCII other than digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_RULES = "array<struct<order:int,label:string,priority:int,keywords:array<string>,confidence:double,pattern:string>>"


def spaced(text: Column) -> Column:
    """A-Z lower-cased words with one space before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), GAP, " ")


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.translate(x, " ", ""))).cast("long")


def _on_words(pattern: Column) -> Column:
    return F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))


def _found(words: Column, pattern: Column) -> Column:
    """(start, end) in characters of each place where the pattern's words stand."""

    def places(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda g, h: F.length(g) + F.length(h))
        ends = running(sizes, lambda a, b: a + b)
        return F.zip_with(ends, x["hits"], lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end")))

    return let(F.struct(F.split(words, pattern, -1).alias("gaps"), F.regexp_extract_all(words, pattern, F.lit(0)).alias("hits")), places)


def _detections(words: Column, table: list[Rule]) -> Column:
    """All detections of all rules, by start, then longest and strongest first."""
    literal = F.from_json(F.lit(json.dumps([r._asdict() for r in table])), _RULES)
    there = F.array_distinct(F.regexp_extract_all(words, F.lit(keyword_pattern(table)), F.lit(1)))

    def hits(r: Column) -> Column:
        return F.transform(
            _found(words, _on_words(r["pattern"])),
            lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("end"), r["priority"].alias("priority"), r["order"].alias("order"), r["label"].alias("label"), r["confidence"].alias("confidence")),
        )

    def tried(there: Column) -> Column:
        matching = F.filter(literal, lambda r: F.arrays_overlap(r["keywords"], there) & F.regexp_like(words, _on_words(r["pattern"])))
        return F.when(F.size(there) > 0, F.array_sort(F.flatten(F.transform(matching, hits)))).otherwise(F.array().cast(f"array<{_DETECTION}>"))

    return let(there, tried)


def _standing(detections: Column, priorities: int) -> Column:
    """Detections that no stronger or equal one contains.

    In order of start, an earlier one contains the next if it ends no earlier: what counts
    is the furthest end so far of the priorities up to the next one's.
    """

    def standing(found: Column) -> Column:
        def ends(p: int) -> Column:
            return F.transform(found, lambda d: F.when(d["priority"] <= p, -d["end"]).otherwise(-1))

        reach = F.array(*(running(ends(p), F.greatest) for p in range(1, priorities + 1)))
        return let(reach, lambda m: F.filter(found, lambda d, i: F.coalesce(F.get(F.get(m, d["priority"] - 1), i - 1), F.lit(-1)) < -d["end"]))

    return let(detections, lambda found: F.when(F.size(found) > 0, standing(found)).otherwise(found))


def _base(words: Column, phrases: dict[str, str]) -> Column:
    """Places of plain phrases: how many, the first and last word, and the labels."""
    either = F.lit("|".join(phrases))

    def placed(x: Column) -> Column:
        n = F.size(x["hits"]).cast("long")
        last = _spaces(words) - 1 - (_spaces(F.element_at(x["gaps"], -1)) - 1) - (_spaces(F.element_at(x["hits"], -1)) + 1)
        labels = F.array_distinct(F.transform(x["hits"], lambda h: F.element_at(F.create_map(*(F.lit(v) for kv in phrases.items() for v in kv)), h)))
        return F.struct(n.alias("n"), (_spaces(F.get(x["gaps"], F.lit(0))) - 1).alias("first"), last.alias("last"), F.array_sort(labels).alias("labels"))

    pattern = _on_words(either)
    found = let(F.struct(F.split(words, pattern, -1).alias("gaps"), F.regexp_extract_all(words, pattern, F.lit(0)).alias("hits")), placed)
    none = F.lit(None).cast("bigint")
    nothing = F.struct(F.lit(0).cast("long").alias("n"), none.alias("first"), none.alias("last"), F.array().cast("array<string>").alias("labels"))
    return F.when(words.rlike("(?<= )(?:" + "|".join(phrases) + ")(?= )"), found).otherwise(nothing)


def scan(df: DataFrame, *, keys: list[str], text_col: str, phrases: dict[str, str], table: list[Rule] | None = None) -> DataFrame:
    """``keys`` of every row with what its whole text says about licences.

    Columns: n_words; n_base, first_word, last_word, base_labels for the ``phrases``
    (words -> label; no two may overlap); labels: these and the rules'; score: the
    certainty of the surest label, 1 for a phrase's; detections: (label, start, end,
    confidence) of the rules, in characters of the spaced words.

    Null and empty texts have no words, no labels and score 0; repeated rows give repeated
    results; other columns are not read. An empty table gives an empty result.
    """
    table = rules() if table is None else table
    priorities = max(r.priority for r in table)

    def seen(words: Column) -> Column:
        ruled = _standing(_detections(words, table), priorities)
        return F.struct((_spaces(words) - 1).alias("n_words"), _base(words, phrases).alias("base"), ruled.alias("ruled"))

    made = df.select(*keys, let(spaced(F.col(text_col)), seen).alias("__s"))
    s = F.col("__s")
    labels = F.array_sort(F.array_union(s["base"]["labels"], F.transform(s["ruled"], lambda d: d["label"])))
    score = F.greatest(F.when(s["base"]["n"] > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform(s["ruled"], lambda d: d["confidence"])), F.lit(0.0)))
    shown = F.transform(s["ruled"], lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), (-d["end"]).alias("end"), d["confidence"].alias("confidence")))
    return made.select(
        *keys,
        s["n_words"].alias("n_words"),
        s["base"]["n"].alias("n_base"),
        s["base"]["first"].alias("first_word"),
        s["base"]["last"].alias("last_word"),
        F.array_join(s["base"]["labels"], ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        shown.alias("detections"),
    )

"""op8: all documents judged by quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality_rules import GAMMA, MEASURES, MIN_ROWS, MOST_BINS, REACH, TAILS, judge


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The rules, sketches and fences as SQL."""
    two_sided = ", ".join(f"'{m}'" for m, both in MEASURES.items() if both)
    first = lambda side: "coalesce(" + ", ".join(f"nullif({side}_{k}, mid)" for k in range(len(TAILS))) + ")"
    level = lambda name, q: f"min(bin) FILTER (WHERE cum >= {q!r}::DOUBLE * total) AS {name}"
    levels = ", ".join([level("mid", 0.5), *(level(f"low_{k}", t) for k, t in enumerate(TAILS)), *(level(f"high_{k}", 1 - t) for k, t in enumerate(TAILS))])

    def fences(name: str, by: str) -> str:
        group = f"{by}, measure" if by else "measure"
        return f"""
{name}_cum AS (
    SELECT {group}, bin, n, sum(n) OVER (PARTITION BY {group} ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {group}) AS total
    FROM (SELECT {group}, bin, sum(n) AS n FROM bins GROUP BY {group}, bin)
),
{name}_q AS (
    SELECT {group}, total, {levels} FROM {name}_cum GROUP BY {group}, total
),
{name} AS (
    SELECT {group}, total, CASE WHEN measure IN ({two_sided}) THEN {first("low")} + {REACH} * ({first("low")} - mid) END AS low,
        {first("high")} + {REACH} * ({first("high")} - mid) AS high
    FROM {name}_q
)"""

    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
word AS (SELECT rid, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM w),
gram AS (
    SELECT rid, i, string_agg(word, ' ') OVER v AS gram, count(*) OVER v AS n
    FROM word WINDOW v AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM gram WHERE n = 8) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(8) AS r(k) GROUP BY rid),
echo AS (SELECT rid, count(*) AS n FROM (SELECT rid, word = lag(word) OVER (PARTITION BY rid ORDER BY i) AS e FROM word) WHERE e GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
    SELECT w.rid, doc_id, lang, source, len(words) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
        coalesce(e.n, 0) AS n_echoes
    FROM w LEFT JOIN echo e ON w.rid = e.rid LEFT JOIN covered c ON w.rid = c.rid LEFT JOIN lines l ON w.rid = l.rid
),
judged AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words END AS word_length,
        CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words END AS symbols_per_word,
        CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines END AS dup_line_share,
        CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words END AS repeat_share,
        CASE WHEN n_words > 0 THEN n_echoes::DOUBLE / n_words END AS echo_share
    FROM m
),
each_v AS (
    {" UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS measure, {m} AS v FROM judged WHERE NOT base_failed" for m in MEASURES)}
),
each_m AS (
    SELECT *, CAST(greatest(least(ceil(ln(v) / ln({GAMMA}::DOUBLE)), {MOST_BINS}), {1 - MOST_BINS}) AS INTEGER) AS bin FROM each_v WHERE v > 0
),
bins AS (SELECT lang, source, measure, bin, count(*) AS n FROM each_m GROUP BY ALL),{fences("own", "lang, source")},{fences("upper_of", "lang")},{fences("whole", "")},
out AS (
    SELECT DISTINCT e.rid FROM each_m e
    JOIN own o ON e.lang IS NOT DISTINCT FROM o.lang AND e.source IS NOT DISTINCT FROM o.source AND e.measure = o.measure
    JOIN upper_of u ON e.lang IS NOT DISTINCT FROM u.lang AND e.measure = u.measure
    JOIN whole t ON e.measure = t.measure
    WHERE e.bin < CASE WHEN o.total >= {MIN_ROWS} THEN o.low WHEN u.total >= {MIN_ROWS} THEN u.low ELSE t.low END
       OR e.bin > CASE WHEN o.total >= {MIN_ROWS} THEN o.high WHEN u.total >= {MIN_ROWS} THEN u.high ELSE t.high END
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND out.rid IS NULL AS kept
FROM judged LEFT JOIN out ON judged.rid = out.rid
"""


QUERIES = {"op8_quality_rules": op8_quality_rules}
ORACLE_SQL = {"op8_quality_rules": _sql()}

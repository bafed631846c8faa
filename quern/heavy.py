"""Joins of two tables that make far more rows than they read, dealt over as many tasks as the rows need.

Spark sizes the tasks of a join by what they read: small tables whose keys many rows share are
joined in one task, however many pairs that makes. Sketches of the keys (``cyclic``) tell
how many pairs there are, and of the most common key. Where they blow up, each key's
rows of one table are dealt over salts, those of the other copied to all of them, and
both are shuffled by key and salt to so many tasks that each makes about ``TASK_PAIRS``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import cyclic
from .dialect import _trial, outer_block, text

#: Pairs that a task makes, about.
TASK_PAIRS = 16_000_000
#: Tasks at most.
_TASKS = 8192


def _key(column: str, kind: T.DataType) -> str | None:
    """What is equal where the column is, in a type by which Spark deals and joins alike."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return f"CAST({column} + CAST(0 AS DOUBLE) AS STRING)"  # one text for each value, and for both zeros
    return column if isinstance(kind, (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) else None


def spread(spark: SparkSession, sql: str, names: list[str]) -> DataFrame | None:
    """The query with its join so dealt; None where that doesn't pay or it isn't a plain join of two tables."""
    found = cyclic.plain_query(spark, sql, 2, 1)
    if found is None or len(found[2]) != 2:
        return None
    prefix, some, items, conjuncts = found
    if cyclic.has_stars(some):
        return None
    types = {(i.alias, f.name): f.dataType for i in items for f in i.schema}
    keys: dict[str, list[str]] = {i.alias: [] for i in items}
    rest, filters = [], {i.alias: [] for i in items}
    for c in conjuncts:
        pair = cyclic._key_pair(items, c)
        if pair and types[pair[0]] == types[pair[1]] and all(_key("", types[x]) is not None for x in pair):
            for alias, column in pair:
                keys[alias].append(_key(f"`{alias}`.`{column}`", types[alias, column]))
            continue
        owners = {o[0] for q, n in cyclic._names(c) if (o := cyclic._owner(items, q, n))}
        known = all(cyclic._owner(items, q, n) for q, n in cyclic._names(c) if q)
        (filters[owners.pop()] if len(owners) == 1 and known else rest).append(text(c))
    one, other = (i.alias for i in items)
    if not keys[one]:
        return None
    where = {a: f" WHERE {' AND '.join(f'({f})' for f in own)}" if own else "" for a, own in filters.items()}
    listed = {a: ", ".join(f"{k} AS __k{n}" for n, k in enumerate(own)) for a, own in keys.items()}
    sketched = {i.alias: spark.sql(f"{prefix} SELECT {listed[i.alias]} FROM {i.source}{where[i.alias]}").dropna() for i in items}
    plans = {a: df._jdf.queryExecution().optimizedPlan() for a, df in sketched.items()}
    size = {a: int(str(p.stats().sizeInBytes())) for a, p in plans.items()}
    small, large = sorted((one, other), key=size.get)
    place = tuple(range(len(keys[one])))
    rows, sums = cyclic._sketches({small: sketched[small]}, {small: [place]})
    if sum(s * s for s in sums.get((small, place), {}).values()) <= cyclic._NEAR_KEY * rows[small]:
        return None  # its rows have keys of their own
    if plans[small].sameResult(plans[large]):
        rows[large], sums[large, place] = rows[small], sums.get((small, place), {})
    else:
        more = cyclic._sketches({large: sketched[large]}, {large: [place]})
        rows, sums = rows | more[0], sums | more[1]
    cells = sums.get((large, place), {})
    made = [s * cells.get(c, 0) for c, s in sums.get((small, place), {}).items()]
    if sum(made) <= max(TASK_PAIRS, cyclic.BLOW_UP * (rows[small] + rows[large])):
        return None
    tasks = min(_TASKS, -(-sum(made) // TASK_PAIRS))
    salts = min(tasks, max(1, -(-max(made) // TASK_PAIRS)))
    salt = {large: f"CAST(pmod(monotonically_increasing_id(), {salts}) AS INT)", small: f"explode(sequence(0, {salts - 1}))"}
    dealt = ", ".join([*(f"__k{n}" for n in place), "__salt"])
    sources = [f"(SELECT /*+ REPARTITION({tasks}, {dealt}) */ * FROM (SELECT `{i.alias}`.*, {listed[i.alias]}, {salt[i.alias]} AS __salt FROM {i.source}{where[i.alias]})) AS `{i.alias}`" for i in items]
    block = outer_block(some)
    clause = {name: text(some[slice(*span)]) for name, span in block.clauses.items()}
    met = [f"({r})" for r in rest] + [f"`{one}`.{c} = `{other}`.{c}" for c in dealt.split(", ")]
    after = "".join(f" {name} {clause[name]}" for name in ("GROUP", "HAVING", "ORDER", "LIMIT") if name in clause)
    return spark.sql(f"{prefix} SELECT {clause['SELECT']} FROM {', '.join(sources)} WHERE {' AND '.join(met)}{after}").toDF(*names)


def run(spark: SparkSession, sql: str) -> DataFrame:
    """A query of Spark SQL, by :func:`spread` or :func:`cyclic.run`, whichever it is for."""
    rows = cyclic.run(spark, sql)
    if spark.conf.get("spark.quern.multiway", "auto") == "never" or not rows._jdf.queryExecution().analyzed().deterministic():
        return rows
    try:
        with _trial():
            dealt = spread(spark, sql, rows.columns)
        return rows if dealt is None else dealt
    except AnalysisException:
        return rows

"""Cyclic equi-joins in SQL: found in a query's text, and run by the multi-way join where that pays.

A query whose FROM list joins three or more tables in a cycle of integer keys has a cyclic
core: what is left when tables that only hang on another are taken away, one after another.
Any plan of binary joins begins with a join of two tables of the core. If even the smallest
of these makes far more rows than it reads, :func:`multiway_join` finds the core's
bindings instead, and the query goes on from them:

* a table of which the rest of the query uses keys only is not joined again; its copies
  are in the bindings' multiplicity, which ``count(*)`` sums and other queries expand;
* other tables of the core are joined to the bindings on all their keys, so no join
  makes more rows than the core's result has;
* tables outside the core are joined by Catalyst as ever.

Sizes of joins are estimated from signed sums of hashed keys, a bounded sketch for each
table, so hot keys count with the square of their rows. That takes one pass over the keys
of the core's tables, sub-queries among them; of the smallest table alone where its keys
are its own.
``spark.quern.multiway`` is ``auto``, ``always`` (any cyclic core) or ``never``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import Token, _first_query, _solid, _trial, outer_block, text, tokens
from .operators import multiway_join

#: A first join pays no more when it makes over so many times the rows it reads.
BLOW_UP = 4
#: A key's self-join makes so many times its rows at most where few rows share one.
_NEAR_KEY = 1.5
#: Cells of a sketch.
_CELLS = 1024
#: Copies of a binding that are expanded at a time.
_COPIES = 1 << 16
_OTHER_JOINS = {"LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "SEMI", "ANTI", "NATURAL", "USING", "LATERAL", "TABLESAMPLE", "PIVOT", "UNPIVOT"}
_BINDINGS = "__bindings"
#: Has Spark delete a query's shuffles at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Item:
    """A table of the FROM list."""

    alias: str
    source: str
    schema: T.StructType = field(default_factory=T.StructType)

    def column(self, name: str) -> str | None:
        return next((c for c in self.schema.names if c.lower() == name), None)


@dataclass
class Cycle:
    """A query with a cyclic core; ``variables[alias]`` maps its keys' variables to columns."""

    prefix: str
    some: list[Token]
    items: list[Item]
    conjuncts: list[list[Token]]
    variables: dict[str, dict[str, str]]


def _pieces(some: list[Token], at: set[str]) -> list[list[Token]]:
    """The parts between words ``at`` of depth 0; the AND of a BETWEEN doesn't part."""
    found, depth, between = [[]], 0, False
    for t in some:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.word == "BETWEEN":
            between = True
        if depth == 0 and t.word == "AND" and between:
            between = False
        elif depth == 0 and t.word in at:
            found.append([])
            continue
        found[-1].append(t)
    return [p for p in found if _solid(p)]


def _top(some: list[Token]) -> set[str]:
    """Words of depth 0."""
    depth, found = 0, set()
    for t in some:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0:
            found.add(t.word)
    return found


def _conjuncts(some: list[Token]) -> list[list[Token]]:
    top = _top(some)
    return [some] if "OR" in top or "CASE" in top else _pieces(some, {"AND"})


def _item(some: list[Token]) -> Item | None:
    solid = [t for _, t in _solid(some)]
    last = solid[-1]
    if last.kind not in ("name", "quoted"):
        return None
    alone = all(t.text == "." if k % 2 else t.kind in ("name", "quoted") for k, t in enumerate(solid))
    alias = last.text.strip("`").lower()
    return Item(alias, f"{text(some)} AS `{alias}`" if alone else text(some))


def _names(some: list[Token]) -> list[tuple[str | None, str]]:
    """(qualifier, name) of what may be columns."""
    solid = [t for _, t in _solid(some)]
    found = []
    for k, t in enumerate(solid):
        before, after = solid[k - 1].text if k else "", solid[k + 1].text if k + 1 < len(solid) else ""
        if t.kind not in ("name", "quoted") or after in ("(", "."):
            continue
        found.append((solid[k - 2].text.strip("`").lower() if before == "." and k > 1 else None, t.text.strip("`").lower()))
    return found


def _owner(items: list[Item], qualifier: str | None, name: str) -> tuple[str, str] | None:
    """(alias, column), where one table has it."""
    found = [(i.alias, c) for i in items if qualifier in (None, i.alias) and (c := i.column(name))]
    return found[0] if len(found) == 1 else None


def _core(edges: dict[str, set[str]]) -> dict[str, set[str]]:
    """What is left of the tables' variables when ears are taken away, one after another."""
    left = {a: set(v) for a, v in edges.items()}
    while True:
        for a, own in left.items():
            own -= {v for v in own if sum(v in other for other in left.values()) == 1}
        ear = next((a for a, own in left.items() if any(own <= other for b, other in left.items() if b != a)), None)
        if ear is None:
            return left if len(left) > 2 else {}
        del left[ear]


def plain_query(spark: SparkSession, sql: str, tables: int, equal_keys: int) -> tuple[str, list[Token], list[Item], list[list[Token]]] | None:
    """(what is before SELECT, tokens, tables, conditions) of a query of Spark SQL; None where it isn't plain.

    Plain are a single SELECT of inner joins, without sub-queries but in FROM and WITH, of at least
    so many tables and conditions that may set keys equal.
    """
    some = [Token("space", " ") if t.kind == "space" else t for t in tokens(sql)]  # comments would run on
    block = outer_block(some)
    if not {"SELECT", "FROM"} <= set(block.clauses) or len(_first_query(some)) < len(some):
        return None
    start = block.clauses["SELECT"][0] - 1
    low, high = block.clauses["FROM"]
    source = some[low:high]
    outside = some[start + 1 : low] + some[high:]
    if _top(source) & _OTHER_JOINS or any(t.word in ("SELECT", "WINDOW", "OVER") for t in outside):
        return None
    conjuncts = _conjuncts(some[slice(*block.clauses["WHERE"])]) if "WHERE" in block.clauses else []
    items = []
    for piece in _pieces([t for t in source if t.word != "INNER"], {",", "JOIN"}):
        table, *on = _pieces(piece, {"ON"})
        item = _item(table)
        if item is None or len(on) > 1:
            return None
        items.append(item)
        conjuncts += [c for o in on for c in _conjuncts(o)]
    equal = [c for c in conjuncts if [t.text for _, t in _solid(c)].count("=") == 1 and len(_solid(c)) <= 7]
    if len(items) < tables or len(equal) < equal_keys or len({i.alias for i in items}) < len(items):
        return None
    prefix = text(some[:start])
    for item in items:
        item.schema = spark.sql(f"{prefix} SELECT * FROM {item.source}").schema
    return prefix, some, items, conjuncts


def find_cycle(spark: SparkSession, sql: str) -> Cycle | None:
    """The cyclic core of a query of Spark SQL; None where there is none or it isn't plain."""
    found = plain_query(spark, sql, 3, 3)
    if found is None:
        return None
    prefix, some, items, conjuncts = found
    equal = [c for c in conjuncts if [t.text for _, t in _solid(c)].count("=") == 1 and len(_solid(c)) <= 7]
    group: dict[tuple[str, str], tuple[str, str]] = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    integral = {(i.alias, f.name) for i in items for f in i.schema if isinstance(f.dataType, T.IntegralType)}
    for c in equal:
        if pair := _key_pair(items, c):
            if integral.issuperset(pair):
                group[root(pair[0])] = root(pair[1])
    classes: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for x in list(group):
        classes.setdefault(root(x), []).append(x)
    edges: dict[str, dict[str, str]] = {}
    for k, members in enumerate(sorted(sorted(m) for m in classes.values())):
        if len({a for a, _ in members}) < len(members):
            return None  # columns of one table are equal to each other
        for alias, column in members:
            edges.setdefault(alias, {})[f"v{k}"] = column
    core = _core({a: set(own) for a, own in edges.items()})
    if not core:
        return None
    return Cycle(prefix, some, items, conjuncts, {a: {v: edges[a][v] for v in sorted(own, key=edges[a].get)} for a, own in core.items()})


def _key_pair(items: list[Item], conjunct: list[Token]) -> list[tuple[str, str]] | None:
    """The two tables' columns of ``a.x = b.y``."""
    sides = _pieces(conjunct, {"="})
    if len(sides) != 2:
        return None
    pair = []
    for side in sides:
        solid = [t for _, t in _solid(side)]
        plain = len(solid) in (1, 3) and all(t.text == "." if k % 2 else t.kind in ("name", "quoted") for k, t in enumerate(solid))
        names = _names(side)
        if not plain or len(names) != 1 or (owner := _owner(items, *names[0])) is None:
            return None
        pair.append(owner)
    return pair if pair[0][0] != pair[1][0] else None


def _sketches(tables: dict[str, DataFrame], shared: dict[str, list[tuple[int, ...]]]) -> tuple[dict[str, int], dict]:
    """Rows of each table, and signed sums by hashed key for each of its sets of ``shared`` columns."""
    spark = next(iter(tables.values())).sparkSession
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # or sub-queries' shuffles stay on disk beside those of the query
    try:
        return _read_sketches(tables, shared)
    finally:
        if kept is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, kept)


def _read_sketches(tables: dict[str, DataFrame], shared: dict[str, list[tuple[int, ...]]]) -> tuple[dict[str, int], dict]:
    parts = None
    for name, df in tables.items():
        keys = [F.struct(F.lit(k).alias("k"), F.xxhash64(*(df.columns[p] for p in keyed)).alias("h")) for k, keyed in enumerate(shared[name])]
        hashed = df.select(F.explode(F.array(*keys)).alias("x")).select(F.lit(name).alias("rel"), "x.k", "x.h")
        cell = F.pmod("h", F.lit(_CELLS)).cast("int")
        sign = F.lit(1) - 2 * F.getbit(F.col("h"), F.lit(40)).cast("int")
        part = hashed.groupBy("rel", "k", cell.alias("cell")).agg(F.sum(sign).alias("s"), F.count(F.lit(1)).alias("n"))
        parts = part if parts is None else parts.unionByName(part)
    rows, sums = dict.fromkeys(tables, 0), {}
    for rel, k, cell, s, n in parts.collect():  # at most _CELLS rows for each set
        rows[rel] += n if k == 0 else 0
        sums.setdefault((rel, shared[rel][k]), {})[cell] = s
    return rows, sums


def _pays(relations: dict[str, DataFrame]) -> tuple[bool, list[int] | None]:
    """Whether every first binary join blows up, and the relations' rows where all were read."""
    like: dict[str, str] = {}  # the first relation of the same rows, as where a table of edges meets itself
    plans = {a: df._jdf.queryExecution().optimizedPlan() for a, df in relations.items()}
    for a in relations:
        like[a] = next((b for b in dict.fromkeys(like.values()) if plans[b].sameResult(plans[a])), a)
    pairs = []
    for i, (a, one) in enumerate(relations.items()):
        for b, other in list(relations.items())[i + 1 :]:
            if both := [v for v in sorted(one.columns) if v in other.columns]:
                pairs.append([(like[x], tuple(df.columns.index(v) for v in both)) for x, df in ((a, one), (b, other))])
    shared: dict[str, list[tuple[int, ...]]] = {}
    for name, keyed in dict.fromkeys(side for pair in pairs for side in pair):
        shared.setdefault(name, []).append(keyed)
    size = {a: int(str(plans[a].stats().sizeInBytes())) for a in shared}
    rows: dict[str, int] = {}
    sums: dict = {}
    # most queries are told by their smallest table, whose rows have a key of their own
    smallest = min(size, key=size.get)
    for some in ({smallest}, set(shared) - {smallest}):
        if not some:
            continue
        more = _sketches({a: relations[a] for a in shared if a in some}, shared)
        rows |= more[0]
        sums |= more[1]
        if any(sum(s * s for s in sums.get((smallest, keyed), {}).values()) <= _NEAR_KEY * rows[smallest] for keyed in shared[smallest]):
            return False, None
    for one, other in pairs:
        cells = sums.get(other, {})
        made = sum(s * cells.get(cell, 0) for cell, s in sums.get(one, {}).items())
        if made <= BLOW_UP * (rows[one[0]] + rows[other[0]]):
            return False, None
    return True, [rows[like[a]] for a in relations]


def _counts_only(cycle: Cycle) -> bool:
    """Whether the query groups, with no other aggregate than count(*), min and max."""
    block = outer_block(cycle.some)
    low = block.clauses["FROM"][0]
    tail = [t for name, span in block.clauses.items() if name in ("HAVING", "ORDER") for t in cycle.some[slice(*span)]]
    solid = [t for _, t in _solid(cycle.some[block.clauses["SELECT"][0] : low - 1] + tail)]
    called = [(t.word, solid[k + 2].text) for k, t in enumerate(solid[:-2]) if t.kind == "name" and solid[k + 1].text == "("]
    return ("GROUP" in block.clauses or bool(called)) and all(name in ("MIN", "MAX") or (name, x) == ("COUNT", "*") for name, x in called)


def _sum_counts(some: list[Token]) -> list[Token]:
    """``count(*)`` as the sum of multiplicities."""
    out, solid = list(some), _solid(some)
    for k in range(len(solid) - 3):
        at = [i for i, _ in solid[k : k + 4]]
        if [some[i].word for i in at] == ["COUNT", "(", "*", ")"]:
            out[at[0]] = Token("name", f"coalesce(sum({_BINDINGS}.multiplicity), 0L)")
            for i in at[1:]:
                out[i] = Token("space", " ")
    return out


def _rewrite(spark: SparkSession, cycle: Cycle, relations: dict[str, DataFrame], sizes: list[int] | None, filters: dict[str, list[str]], names: list[str]) -> DataFrame:
    block = outer_block(cycle.some)
    variables = cycle.variables
    keys = {(a, c): v for a, own in variables.items() for v, c in own.items()}
    within = [c for c in cycle.conjuncts if (pair := _key_pair(cycle.items, c)) and all(x in keys for x in pair)]
    own_filters = [c for c in cycle.conjuncts if text(c) in {f for some in filters.values() for f in some}]
    clause = {name: cycle.some[slice(*span)] for name, span in block.clauses.items()}
    rest = [c for c in cycle.conjuncts if not any(c is x for x in within + own_filters)]
    used = {o for part in [*rest, *(s for n, s in clause.items() if n not in ("FROM", "WHERE"))] for q, n in _names(part) for o in [_owner(cycle.items, q, n)] if o}
    covered = [a for a in variables if all((b, c) in keys for b, c in used if b == a)]
    joined = [(df if a in covered else df.distinct(), list(df.columns)) for a, df in relations.items()]
    found = multiway_join(joined, sizes=sizes)
    counted = _counts_only(cycle)
    if not counted:
        copies = F.col("multiplicity")
        found = found.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(multiplicity - 1) DIV {_COPIES}"))))
        found = found.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_COPIES).cast("long"), copies - F.col("__k") * _COPIES))))
    # `alias.column` finds a field of column `alias`, and `column` a column
    schemas = {i.alias: i.schema for i in cycle.items}
    everywhere = [c.lower() for i in cycle.items for c in i.schema.names]
    columns = [F.col(v).alias(f"__{v}") for v in dict.fromkeys(v for own in variables.values() for v in own)]
    for a in covered:
        own = [F.col(v).cast(schemas[a][c].dataType).alias(c) for v, c in variables[a].items()]
        columns += [F.struct(*own).alias(a), *(x for x, c in zip(own, variables[a].values()) if everywhere.count(c.lower()) == 1)]
    view = f"__cyclic_{uuid.uuid4().hex}"
    found.select(*columns, "multiplicity").createOrReplaceTempView(view)
    back = [a for a in variables if a not in covered]
    where = [f"({text(c)})" for c in rest]
    where += [f"({f})" for a, some in filters.items() if a in back for f in some]
    where += [f"`{a}`.`{c}` = {_BINDINGS}.__{v}" for a in back for v, c in variables[a].items()]
    sources = [f"`{view}` AS {_BINDINGS}", *(i.source for i in cycle.items if i.alias not in covered)]
    after = [t for name in ("GROUP", "HAVING", "ORDER", "LIMIT") if name in clause for t in [Token("space", " "), Token("name", name), *clause[name]]]
    head = clause["SELECT"]
    if counted:
        head, after = _sum_counts(head), _sum_counts(after)
    sql = f"{cycle.prefix} SELECT {text(head)} FROM {', '.join(sources)}" + (f" WHERE {' AND '.join(where)}" if where else "") + text(after)
    try:
        return spark.sql(sql).toDF(*names)
    finally:
        spark.catalog.dropTempView(view)


def run(spark: SparkSession, sql: str) -> DataFrame:
    """A query of Spark SQL, with its cyclic core by the multi-way join where that pays."""
    rows = spark.sql(sql)
    mode = spark.conf.get("spark.quern.multiway", "auto")
    if mode == "never" or not rows._jdf.queryExecution().analyzed().deterministic():
        return rows
    try:
        with _trial():
            routed = _routed(spark, sql, mode, rows.columns)
        return rows if routed is None else routed
    except AnalysisException:  # what only Spark can tell apart, such as a column called like a table
        return rows


def _routed(spark: SparkSession, sql: str, mode: str, names: list[str]) -> DataFrame | None:
    cycle = find_cycle(spark, sql)
    if cycle is None or has_stars(cycle.some):
        return None
    filters: dict[str, list[str]] = {a: [] for a in cycle.variables}
    for c in cycle.conjuncts:
        owners = {_owner(cycle.items, q, n) for q, n in _names(c)} - {None}
        aliases = {a for a, _ in owners}
        if len(aliases) == 1 and (alias := aliases.pop()) in filters:
            filters[alias].append(text(c))
    relations = {}
    for item in cycle.items:
        if item.alias in cycle.variables:
            own = cycle.variables[item.alias]
            where = f" WHERE {' AND '.join(f'({f})' for f in filters[item.alias])}" if filters[item.alias] else ""
            keyed = spark.sql(f"{cycle.prefix} SELECT {', '.join(f'`{item.alias}`.`{c}` AS {v}' for v, c in own.items())} FROM {item.source}{where}")
            # nulls never join
            relations[item.alias] = keyed.dropna().select(*(F.col(v).cast("long").alias(v) for v in own))
    pays, sizes = (True, None) if mode == "always" else _pays(relations)
    return _rewrite(spark, cycle, relations, sizes, filters, names) if pays else None


def has_stars(some: list[Token]) -> bool:
    """Whether stars of the select list stand for columns."""
    block = outer_block(some)
    solid = [t for _, t in _solid(some[slice(*block.clauses["SELECT"])])]
    return any(True for k, t in enumerate(solid) if t.text == "*" and (k == 0 or solid[k - 1].text in (".", ",") or solid[k - 1].word in ("DISTINCT", "ALL")))

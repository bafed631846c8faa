"""The SQL front end: what the dialect has and Spark SQL lacks, as rewrites of tokens.

Queries are parsed, analysed and planned by Spark. This module only
 * orders nulls last when ascending and first when descending, unless told otherwise;
 * divides integers as integers;
 * takes ``1.5`` for a double, ``TIMESTAMP '...'`` for one without zone, ``"x"`` for a name;
 * expands select aliases that a WHERE clause uses;
 * asks for NOT IN by joins that need no side in one memory;
 * names columns that have no alias;
 * splits scripts, and finds what kind of statement a text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.logger import PySparkLogger
from pyspark.sql import SparkSession


class Token(NamedTuple):
    kind: str
    text: str

    @property
    def word(self) -> str:
        """Upper-case keyword or name, else the text."""
        return self.text.upper() if self.kind == "name" else self.text


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^']|'')*')
      | (?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
      | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?[A-Za-z]*)
      | (?P<name>[A-Za-z_][A-Za-z_0-9]*)
      | (?P<sign><>|<=|>=|!=|\|\||::|.)""",
    re.VERBOSE | re.DOTALL,
)
_ENDS_ORDER = {"LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "ROWS", "RANGE", "FETCH", ";"}
_ESCAPES = {"D": "DATE", "T": "TIME", "TS": "TIMESTAMP_NTZ"}


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql)]


def text(some: list[Token]) -> str:
    return "".join(t.text for t in some)


def _solid(some: list[Token]) -> list[tuple[int, Token]]:
    return [(i, t) for i, t in enumerate(some) if t.kind != "space"]


def split_script(sql: str) -> list[str]:
    """The statements of a text, without their semicolons and empty ones."""
    found, own = [], []
    for t in tokens(sql):
        if t.text == ";":
            found.append(text(own))
            own = []
        else:
            own.append(t)
    found.append(text(own))
    return [s.strip() for s in found if any(t.kind != "space" for t in tokens(s))]


# -- literals and names -----------------------------------------------------------------


def plain_literals(some: list[Token]) -> list[Token]:
    """Doubles, timestamps, escapes such as ``{d '...'}`` and quoted names as Spark has them."""
    out, solid = list(some), _solid(some)
    for k, (i, t) in enumerate(solid):
        after = solid[k + 1][1] if k + 1 < len(solid) else Token("end", "")
        if t.kind == "number" and re.fullmatch(r"\d*\.\d*", t.text):
            out[i] = Token("number", f"{t.text}D")
        elif t.kind == "quoted" and t.text[0] == '"':
            out[i] = Token("quoted", "`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif t.word == "TIMESTAMP" and after.kind == "string":
            out[i] = Token("name", "TIMESTAMP_NTZ")
        elif t.text == "{" and after.word in _ESCAPES and k + 3 < len(solid) and solid[k + 3][1].text == "}":
            out[i], out[solid[k + 3][0]] = Token("space", " "), Token("space", " ")
            out[solid[k + 1][0]] = Token("name", _ESCAPES[after.word])
    return out


# -- null order ---------------------------------------------------------------------------


def null_order(some: list[Token]) -> list[Token]:
    """NULLS LAST for ascending and NULLS FIRST for descending keys that don't say."""
    out: list[Token] = []
    depth = 0
    open_at: list[int] = []  # depths of ORDER BY lists being read
    last: list[list[str]] = []  # words of the key being read
    before = ""

    def close() -> None:
        words = last[-1]
        if words and "NULLS" not in words:
            at = len(out)
            while at and out[at - 1].kind == "space":
                at -= 1
            out.insert(at, Token("name", " NULLS FIRST" if words[-1] == "DESC" else " NULLS LAST"))
        last[-1] = []

    for t in some:
        if t.kind == "space":
            out.append(t)
            continue
        if t.text == "(":
            depth += 1
        if open_at and open_at[-1] == depth + (t.text == "(") * 0 and (t.word in _ENDS_ORDER or t.text == ")"):
            close()
            open_at.pop(), last.pop()
        elif open_at and open_at[-1] == depth and t.text == ",":
            close()
        elif open_at and t.text != "(":
            last[-1].append(t.word if depth == open_at[-1] else "x")
        if t.text == ")":
            depth -= 1
        out.append(t)
        if before == "ORDER" and t.word == "BY":
            open_at.append(depth)
            last.append([])
        before = t.word
    while open_at:
        close()
        open_at.pop(), last.pop()
    return out


@contextmanager
def _trial() -> Iterator[None]:
    """Analysis that may fail, without a word in the log."""
    logger = PySparkLogger.getLogger("SQLQueryContextLogger")
    before, logger.disabled = logger.disabled, True
    try:
        yield
    finally:
        logger.disabled = before


# -- integer division -----------------------------------------------------------------------


def integer_division(spark: SparkSession, some: list[Token]) -> list[Token]:
    """``/`` as ``DIV`` wherever both sides are integers.

    Both bind alike, and Spark analyses ``DIV`` for integers but not for doubles: what it
    accepts stays. The dialect has no decimals, for which Spark would take it too.
    """
    out = list(some)
    for i, t in enumerate(some):
        if t.text == "/":
            tried = [*out[:i], Token("name", " DIV "), *out[i + 1 :]]
            try:
                with _trial():
                    spark.sql(text(tried))
            except AnalysisException:
                continue
            out = tried
    return out


# -- aliases in WHERE -------------------------------------------------------------------------


@dataclass
class Block:
    """Where the clauses of a query's outermost SELECT are, as positions of tokens."""

    some: list[Token]
    clauses: dict[str, tuple[int, int]] = field(default_factory=dict)


_CLAUSES = ("SELECT", "INTO", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT")


def outer_block(some: list[Token]) -> Block:
    block, depth, now = Block(some), 0, None
    for i, t in enumerate(some):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.kind == "name" and t.word in _CLAUSES and t.word not in block.clauses:
            if now:
                block.clauses[now] = (block.clauses[now][0], i)
            now = t.word
            block.clauses[now] = (i + 1, len(some))
    return block


def select_items(block: Block) -> list[list[Token]]:
    """The tokens of each select item."""
    low, high = block.clauses["SELECT"]
    items, depth = [[]], 0
    for t in block.some[low:high]:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.text == ",":
            items.append([])
        else:
            items[-1].append(t)
    return items


def select_aliases(block: Block) -> dict[str, list[Token]]:
    """Lower-case alias -> its expression, of items written with AS."""
    found = {}
    for item in select_items(block):
        solid = _solid(item)
        if len(solid) >= 3 and solid[-2][1].word == "AS":
            found[solid[-1][1].text.strip("`").lower()] = item[: solid[-2][0]]
    return found


def column_names(sql: str, given: list[str]) -> list[str]:
    """Names for a query's columns, which Spark calls ``given``.

    Aliases stay. Other items are named for their column or function, else ``default``,
    with 2, 3, ... where a name is taken. An alias that is taken is an error. Names stay as
    they are where items can't be told, as with ``*``.
    """
    block = outer_block(_first_query(tokens(sql)))
    if "SELECT" not in block.clauses:
        return given
    items = [[t for _, t in _solid(item)] for item in select_items(block)]
    if items[0] and items[0][0].word in ("DISTINCT", "ALL"):
        items[0] = items[0][1:]
    starred = any(item and item[-1].text == "*" for item in items)
    if not all(items) or (not starred and len(items) != len(given)):
        return given
    taken: dict[str, str] = {}
    for k, item in enumerate(items):
        name, aliased = _item_name(item, "" if starred else given[k])
        if starred and not aliased:
            continue
        if aliased and name.lower() in taken:
            raise ValueError(f"alias {name} is used more than once")
        n, free = 1, name
        while free.lower() in taken:
            n += 1
            free = f"{name}{n}"
        taken[free.lower()] = free
    return given if starred else list(taken.values())


_BETWEEN_TABLES = {"LEFT", "RIGHT", "FULL", "OUTER", "INNER", "CROSS", "SEMI", "ANTI", "NATURAL"}


def check_tables(sql: str) -> None:
    """Refuse a name that two tables of the outermost FROM share."""
    block = outer_block(_first_query(tokens(sql)))
    low, high = block.clauses.get("FROM", (0, 0))
    tables, depth = [[]], 0
    for t in block.some[low:high]:
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and (t.text == "," or t.word == "JOIN"):
            tables.append([])
        elif t.kind != "space":
            tables[-1].append((depth, t))
    seen = set()
    for item in tables:
        end = next((k for k, (d, t) in enumerate(item) if d == 0 and t.word in ("ON", "USING", "LATERAL")), len(item))
        names = [t for _, t in item[:end] if t.word not in _BETWEEN_TABLES]
        if not names or names[-1].kind not in ("name", "quoted"):
            continue
        name = names[-1].text.strip('`"').lower()
        if name in seen:
            raise ValueError(f"table name {name} is used more than once")
        seen.add(name)


def _first_query(some: list[Token]) -> list[Token]:
    """The tokens before the first set operation."""
    depth = 0
    for i, t in enumerate(some):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.kind == "name" and t.word in ("UNION", "INTERSECT", "EXCEPT", "MINUS"):
            return some[:i]
    return some


def _item_name(item: list[Token], given: str) -> tuple[str, bool]:
    """(name, whether it is an alias) of a select item that Spark calls ``given``."""
    last = item[-1].text.strip('`"')
    is_name = item[-1].kind in ("name", "quoted")
    if is_name and len(item) > 1 and item[-2].word == "AS":
        return last, True
    if is_name and all(t.text == "." if k % 2 else t.kind in ("name", "quoted") for k, t in enumerate(item)):
        return given or last, False
    if is_name and last.lower() == given.lower():
        return last, True
    depth = 0
    for k, t in enumerate(item[1:], 1):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0:
            if k == len(item) - 1 and item[0].kind == "name" and t.text == ")":
                return item[0].text.lower(), False
            break
    return "default", False


def where_aliases(spark: SparkSession, some: list[Token]) -> list[Token]:
    """Select aliases in the WHERE clause, where they name no column, as expressions."""
    for _ in range(32):
        block = outer_block(some)
        if "WHERE" not in block.clauses:
            return some
        try:
            with _trial():
                spark.sql(text(some))
            return some
        except AnalysisException as e:
            if not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                return some
            name = (e.getMessageParameters() or {}).get("objectName", "").strip("`").lower()
        aliases = select_aliases(block)
        if name not in aliases:
            return some
        low, high = block.clauses["WHERE"]
        changed = []
        for i, t in enumerate(some):
            part_of = any(x.text == "." for x in some[max(0, i - 1) : i] + some[i + 1 : i + 2])
            hit = low <= i < high and t.kind in ("name", "quoted") and t.text.strip("`").lower() == name and not part_of
            changed += [Token("sign", "("), *aliases[name], Token("sign", ")")] if hit else [t]
        if changed == some:
            return some
        some = changed
    raise ValueError("over 32 select aliases in WHERE")


# -- NOT IN -----------------------------------------------------------------------------------


_AFTER_WHERE = {"GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "WINDOW", "QUALIFY", "UNION", "INTERSECT", "EXCEPT", "MINUS", "SORT", "CLUSTER", "DISTRIBUTE", "FETCH"}
_NO_OPERAND = {"OR", "NOT", "IN", "IS", "LIKE", "BETWEEN", "CASE", "EXISTS", "SELECT"}
#: Which rows these leave may change from one reading to the next.
_ANY_ROWS = {"LIMIT", "OFFSET", "FETCH", "TABLESAMPLE"}


def _where_conjuncts(some: list[Token], where: int) -> list[tuple[int, int]]:
    """Spans of what AND joins in the WHERE clause at ``where``; none if its conditions can't be told apart."""
    spans, low, depth, between = [], where + 1, 0, False
    for i in range(where + 1, len(some) + 1):
        t = some[i] if i < len(some) else Token("end", "")
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.word in ("OR", "CASE"):
            return []
        if depth < 0 or t.kind == "end" or (depth == 0 and t.word in _AFTER_WHERE):
            return [*spans, (low, i)]
        if depth == 0 and t.word == "AND" and not between:
            spans.append((low, i))
            low = i + 1
        if depth == 0 and t.word in ("AND", "BETWEEN"):
            between = t.word == "BETWEEN"
    return []


def _as_joins(some: list[Token]) -> list[Token] | None:
    """``x NOT IN (SELECT ...)``, one of a WHERE's conditions, as what holds for the same rows."""
    solid = [t for _, t in _solid(some)]
    k = next((k for k, t in enumerate(solid) if t.word == "IN" and [x.word for x in solid[k + 1 : k + 3]] == ["(", "SELECT"]), 0)
    if k > 1 and solid[0].word == "NOT":
        operand = solid[1:k]
    elif k > 1 and solid[k - 1].word == "NOT":
        operand = solid[: k - 1]
    else:
        return None
    if any(t.kind == "sign" and t.text not in ".+-*/%" or t.word in _NO_OPERAND for t in operand):
        return None
    at = [i for i, t in _solid(some) if t.text == "("][0]
    query = some[at:]  # with its brackets
    depths, depth = [], 0
    for t in query:
        depth += (t.text == "(") - (t.text == ")")
        depths.append(depth)
    solid_end = _solid(query)[-1][0]
    if 0 in depths[:solid_end] or depths[solid_end] != 0 or any(t.word in _ANY_ROWS for t in query):
        return None
    rows = f"(SELECT 1 FROM {text(query[: solid_end + 1])} AS __not_in(__value)"
    x = " ".join(t.text for t in operand).replace(" . ", ".")
    return tokens(f" NOT EXISTS {rows} WHERE __not_in.__value = {x}) AND NOT EXISTS {rows} WHERE __not_in.__value IS NULL) AND ({x} IS NOT NULL OR NOT EXISTS {rows})) ")


def not_in(spark: SparkSession, some: list[Token]) -> list[Token]:
    """NOT IN of a query as an anti join on equal keys.

    Spark broadcasts all that a null-aware anti join must not find, whatever its size. NOT IN
    holds where the query has neither the value nor a null, and either the value is known or
    the query is empty. The latter two are asked of the query once, the first is a join by
    its key. Left as they are: conditions under OR or CASE, rows of several values, operands
    that call functions, and queries whose rows may change with each reading.
    """
    out, start = list(some), 0
    while (where := next((i for i in range(start, len(out)) if out[i].word == "WHERE"), None)) is not None:
        start = where + 1
        for low, high in reversed(_where_conjuncts(out, where)):
            if (changed := _as_joins(out[low:high])) is None:
                continue
            tried = [*out[:low], *changed, *out[high:]]
            try:
                with _trial():
                    if spark.sql(text(out))._jdf.queryExecution().analyzed().deterministic():
                        spark.sql(text(tried))
                        out = tried
            except AnalysisException:
                continue
    return out


def to_spark(spark: SparkSession, sql: str) -> str:
    """A query of the dialect as Spark SQL."""
    some = null_order(plain_literals(tokens(sql)))
    return text(not_in(spark, integer_division(spark, where_aliases(spark, some))))


# -- statements -----------------------------------------------------------------------------


@dataclass
class Statement:
    """kind: select, create_table, create_view, drop or other."""

    kind: str
    sql: str
    name: str | None = None
    columns: list[str] = field(default_factory=list)
    #: of create_table: (name, type spelling, flags)
    specs: list[tuple[str, str, set[str]]] = field(default_factory=list)


_NAME = r"[`\"]?([A-Za-z_][\w.]*)[`\"]?"


def parse(sql: str) -> Statement:
    """Tell what a statement is, and take apart those that Spark does not run itself."""
    some = tokens(sql)
    words = [t.word for _, t in _solid(some)]
    if not words:
        raise ValueError("no statement")
    if words[:2] == ["CREATE", "TABLE"] and "AS" not in words[3:5]:
        return _create_table(sql)
    if words[:2] == ["CREATE", "VIEW"]:
        m = re.match(rf"\s*create\s+view\s+{_NAME}\s*(?:\(([^)]*)\))?\s*as\s+(.*)", sql, re.IGNORECASE | re.DOTALL)
        if not m:
            raise ValueError("a view needs a name and a query")
        names = [c.strip(' `"\n') for c in (m[2] or "").split(",") if c.strip()]
        return Statement("create_view", m[3], m[1].lower(), names)
    if words[0] == "DROP":
        m = re.match(rf"\s*drop\s+(?:table\s+|view\s+)?{_NAME}\s*$", sql, re.IGNORECASE)
        if not m:
            raise ValueError("drop needs the name of a table")
        return Statement("drop", sql, m[1].lower())
    if words[0] == "SELECT":
        return _select(sql, some)
    return Statement("select" if words[0] in ("WITH", "(", "VALUES") else "other", sql)


def _select(sql: str, some: list[Token]) -> Statement:
    """SELECT, and apart from it the table that INTO names."""
    block = outer_block(some)
    if "INTO" not in block.clauses:
        return Statement("select", sql)
    low, high = block.clauses["INTO"]
    target = [t for _, t in _solid(some[low:high])]
    if len(target) != 1:
        raise ValueError("SELECT INTO takes one table")
    return Statement("select", text(some[: low - 1] + some[high:]), target[0].text.strip('`"').lower())


_FLAGS = (("primary key", "primary"), ("not null", "not_null"), ("unique", "unique"))


def _create_table(sql: str) -> Statement:
    m = re.match(rf"\s*create\s+table\s+{_NAME}\s*\((.*)\)\s*$", sql, re.IGNORECASE | re.DOTALL)
    if not m:
        raise ValueError("a table needs a name and columns")
    parts, depth = [""], 0
    for c in m[2]:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    specs: list[tuple[str, str, set[str]]] = []
    keys: dict[str, set[str]] = {}
    for part in (" ".join(p.split()) for p in parts):
        low = part.lower()
        if k := re.match(r"(primary key|unique|foreign key) ?\(([^)]*)\)", low):
            for c in k[2].split(","):
                keys.setdefault(c.strip(' `"'), set()).add(k[1].split()[0])
            continue
        flags = {flag for words, flag in _FLAGS if words in low} | ({"foreign"} if " references " in low else set())
        bare = re.sub(r" (primary key|not null|unique|null|references .*|default .*)", "", low)
        name, _, kind = bare.partition(" ")
        if not kind:
            raise ValueError(f"column without a type: {part}")
        specs.append((name.strip('`"'), kind, flags))
    if unknown := set(keys) - {n for n, _, _ in specs}:
        raise ValueError(f"key of unknown columns: {sorted(unknown)}")
    return Statement("create_table", sql, m[1].lower(), [n for n, _, _ in specs], [(n, k, f | keys.get(n, set())) for n, k, f in specs])

"""Every query of the engine's own operators, by name.

Most are SQL of the dialect; where DuckDB writes something else for the same result, the
oracle is given apart. Sums of doubles are rounded, as their order is open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import dialect, heavy
from ..sources import register
from . import frames

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query of the dialect over the tables under ``sf_dir``, whatever views there are."""
    named = {t.word.lower() for t in dialect.tokens(sql) if t.kind == "name"}
    register(spark, sf_dir, [t for t in TABLES if t in named])
    return heavy.run(spark, dialect.to_spark(spark, sql))


def _add(name: str, sql: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, sql)
    ORACLE_SQL[name] = oracle or sql


def _both(name: str, shared: str, spark: dict[str, str], duckdb: dict[str, str]) -> None:
    """One text with places that the two engines fill differently."""
    _add(name, shared.format(**spark), shared.format(**duckdb))


# -- projection ---------------------------------------------------------------------------

_add("scan_project", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_add("star_expand", "SELECT n.*, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
_add("computed_projection", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity - 1 AS less FROM lineitem")
_add("no_columns_needed", "SELECT count(*) AS n FROM orders")
_add("implicit_columns", "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")

# -- filters ------------------------------------------------------------------------------

_add("filter_compare", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag <> 'N'")
_add("filter_and_or_not", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 10 OR l_returnflag = 'R') AND (l_linestatus = 'F' OR l_tax > 0.04)")
_add("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
_add("filter_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45")
_add("filter_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P')")
_add("filter_not_in_list", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')")
_add(
    "filter_is_null",
    "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer) t WHERE v IS NULL",
)
_add("filter_is_not_null", "SELECT k FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer) t WHERE v IS NOT NULL")
_add("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'r_d %'")
_add("filter_not_like", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE 'Brand#1%'")
_add("filter_date_range", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '3' MONTH")
_add(
    "filter_timestamp",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-06-01 00:00:00' + INTERVAL '36' HOUR",
)
_add("filter_same_table", "SELECT s.s_suppkey FROM supplier s, nation n, customer c WHERE s.s_nationkey = n.n_nationkey AND c.c_nationkey = n.n_nationkey AND s.s_suppkey = c.c_custkey")
_add("filter_where_alias", "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE half > 100000")
_add(
    "or_factoring",
    """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part
    WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 21 AND p_size BETWEEN 1 AND 25)
       OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 40)
       OR (p_partkey = l_partkey AND p_brand = 'Brand#7' AND l_quantity >= 20 AND l_quantity <= 40 AND p_size BETWEEN 1 AND 50)""",
)
_add("constant_predicate", "SELECT r_regionkey FROM region WHERE 1 = 1 AND r_name > 'ASIA'")
_add("empty_input_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey < 0")

# -- expressions --------------------------------------------------------------------------

_add(
    "int_div_mod",
    "SELECT o_orderkey, o_orderkey / 7 AS quotient, o_orderkey % 7 AS rest, CAST(-1 * o_orderkey / 7 AS BIGINT) AS negative, -1 * o_orderkey % 7 AS negative_rest FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS quotient, o_orderkey % 7 AS rest, CAST(trunc(-1 * o_orderkey / 7) AS BIGINT) AS negative, -1 * o_orderkey % 7 AS negative_rest FROM orders",
)
_add("double_div", "SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit FROM lineitem WHERE l_quantity > 0")
_both("bitwise", "SELECT c_custkey, c_custkey & 12 AS b_and, c_custkey | 5 AS b_or, {xor} AS b_xor FROM customer", {"xor": "c_custkey ^ 9"}, {"xor": "xor(c_custkey, 9)"})
_add("unary_minus", "SELECT c_custkey, -c_acctbal AS negative, -c_custkey AS negative_key, +c_custkey AS same FROM customer")
_add("concat_strings", "SELECT n_nationkey, n_name || '/' || r_name AS place FROM nation, region WHERE n_regionkey = r_regionkey")
_add("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE WHEN p_size > 40 THEN p_size END AS big FROM part")
_add("case_switch", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders")
_both(
    "cast_numeric",
    "SELECT l_orderkey, l_linenumber, CAST({cut} AS INT) AS whole, CAST(l_quantity AS BIGINT) AS long_quantity, CAST(l_linenumber AS DOUBLE) AS number FROM lineitem",
    {"cut": "l_extendedprice"},
    {"cut": "trunc(l_extendedprice)"},
)
_add(
    "extract_parts",
    "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, CAST(extract(day FROM o_orderdate) AS INT) AS d, CAST(extract(hour FROM o_orderdate) AS INT) AS h, CAST(extract(minute FROM o_orderdate) AS INT) AS mi, CAST(extract(second FROM o_orderdate) AS INT) AS s FROM orders",
)
_add("date_add_months", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL '1' MONTH AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - INTERVAL '1' YEAR AS DATE) AS before FROM orders")
_add("date_add_days", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL '45' DAY AS DATE) AS later, CAST(o_orderdate - INTERVAL '36' HOUR AS DATE) AS before FROM orders")
_add("interval_sum", "SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1995-01-01' + (INTERVAL '1' YEAR + INTERVAL '2' MONTH)")
_add(
    "date_escapes",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= {d '1998-01-01'} AND o_orderdate < {ts '1998-02-01 12:00:00'}",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01 12:00:00'",
)
_add("literals", "SELECT r_regionkey, 7 AS i, 5000000000 AS l, CAST(0.25 AS DOUBLE) AS d, 'it''s' AS s, CAST(NULL AS INT) AS n FROM region")
_add("null_logic", "SELECT k, CASE WHEN v > 1 AND v IS NULL THEN 1 WHEN v > 1 OR v IS NULL THEN 2 WHEN NOT (v > 1) THEN 3 ELSE 4 END AS c FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 END AS v FROM supplier) t")
QUERIES["udf_int_equals"] = frames.udf_int_equals
ORACLE_SQL["udf_int_equals"] = "SELECT n_nationkey, CAST(n_nationkey = n_regionkey AS INTEGER) AS same FROM nation"

# -- joins --------------------------------------------------------------------------------

_add("join_2way", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND o_totalprice > 100000")
_add("join_3way", "SELECT l_orderkey, l_linenumber, c_name FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
_add(
    "join_6way",
    """SELECT s_name, n_name, r_name, count(*) AS n FROM lineitem, orders, customer, supplier, nation, region
    WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND c_mktsegment = 'MACHINERY'
    GROUP BY s_name, n_name, r_name""",
)
_add(
    "join_cyclic",
    """SELECT o_orderkey, l_linenumber, s_suppkey FROM customer, orders, lineitem, supplier, nation
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey""",
)
_add("join_composite_key", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber")
_add("join_on", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0")
_add("join_double_key", "SELECT a.p_partkey AS p1, b.p_partkey AS p2 FROM part a, part b WHERE a.p_retailprice = b.p_retailprice AND a.p_partkey < b.p_partkey")
_add("join_string_key", "SELECT a.s_suppkey, b.c_custkey FROM supplier a, customer b, nation n WHERE a.s_nationkey = n.n_nationkey AND n.n_name = 'NATION_' || CAST(b.c_custkey AS VARCHAR(10))", "SELECT a.s_suppkey, b.c_custkey FROM supplier a, customer b, nation n WHERE a.s_nationkey = n.n_nationkey AND n.n_name = 'NATION_' || CAST(b.c_custkey AS VARCHAR)")
_add("join_theta_residual", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 10 AND (l_suppkey < o_custkey OR l_partkey <> o_custkey)")
_add("join_theta_only", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
_add("join_cross", "SELECT r_name, n_name FROM region, nation")
_add("self_join_pairs", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
QUERIES["join_band"] = frames.join_band
ORACLE_SQL["join_band"] = "SELECT p_partkey, c_custkey FROM part, customer WHERE p_retailprice BETWEEN c_acctbal - 0.5 AND c_acctbal + 0.5"

_EDGES = """r AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
    t AS (SELECT DISTINCT l_suppkey AS s, o_custkey AS c FROM lineitem, orders WHERE l_orderkey = o_orderkey),
    u AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM lineitem, orders WHERE l_orderkey = o_orderkey)"""
_TRIANGLES = f"WITH {_EDGES} SELECT r.s AS s, count(*) AS triangles FROM r, u, t WHERE u.p = r.p AND t.c = u.c AND r.s = t.s GROUP BY r.s"
_add("join_triangle", _TRIANGLES)
QUERIES["join_triangle_multiway"] = frames.join_triangle_multiway
ORACLE_SQL["join_triangle_multiway"] = _TRIANGLES
_CLIQUE_EDGES = """SELECT DISTINCT v.l_suppkey AS x, w.l_suppkey AS y FROM lineitem v, lineitem w
    WHERE v.l_orderkey = w.l_orderkey AND v.l_suppkey < w.l_suppkey AND v.l_quantity > 40 AND w.l_quantity > 40"""
_CLIQUES = f"""WITH e AS ({_CLIQUE_EDGES})
    SELECT ab.x AS a, count(*) AS cliques FROM e ab, e ac, e ad, e bc, e bd, e cd
    WHERE ab.x = ac.x AND ab.x = ad.x AND ab.y = bc.x AND ab.y = bd.x AND ac.y = bc.y AND ac.y = cd.x AND ad.y = bd.y AND ad.y = cd.y GROUP BY ab.x"""
_add("clique4", _CLIQUES)
QUERIES["clique4_multiway"] = frames.clique4_multiway
ORACLE_SQL["clique4_multiway"] = _CLIQUES
QUERIES["join_multiway_bag"] = frames.join_multiway_bag
ORACLE_SQL["join_multiway_bag"] = """SELECT c_custkey AS c, s_suppkey AS s, CAST(c_nationkey AS BIGINT) AS n, count(*) AS multiplicity
    FROM customer, orders, lineitem, supplier WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey GROUP BY ALL"""

# -- sub-queries --------------------------------------------------------------------------

_add("semi_in", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
_add("anti_not_in", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
_add("semi_exists", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority")
_add("anti_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey)")
_add(
    "exists_residual",
    """SELECT a.l_orderkey, a.l_linenumber FROM lineitem a
    WHERE EXISTS (SELECT * FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
      AND NOT EXISTS (SELECT * FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R')""",
)
_add("scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)")
_add("scalar_subquery_empty", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 0) AS nothing FROM customer")
_add("correlated_avg", "SELECT l_orderkey, l_linenumber FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 10 AND l_quantity < (SELECT 0.5 * avg(b.l_quantity) FROM lineitem b WHERE b.l_partkey = p_partkey)")
_add("correlated_min", "SELECT s_suppkey, s_acctbal FROM supplier a WHERE s_acctbal = (SELECT min(b.s_acctbal) FROM supplier b WHERE b.s_nationkey = a.s_nationkey)")
_add("correlated_count", "SELECT o_orderkey FROM orders WHERE 0 = (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)")
_add("having_subquery", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey HAVING sum(l_extendedprice) > (SELECT 1.1 * sum(l_extendedprice) / count(DISTINCT l_suppkey) FROM lineitem)")
_add("derived_table", "SELECT c_count, count(*) AS custdist FROM (SELECT o_custkey, count(o_orderkey) AS c_count FROM orders GROUP BY o_custkey) t GROUP BY c_count")
_add("nested_derived", "SELECT max(m) AS most FROM (SELECT n, max(k) AS m FROM (SELECT c_nationkey AS n, c_custkey AS k FROM customer WHERE c_acctbal > 0) a GROUP BY n) b")
_add("nested_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))")
QUERIES["anti_null_aware"] = frames.anti_null_aware
ORACLE_SQL["anti_null_aware"] = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)"

# -- aggregation --------------------------------------------------------------------------

_add(
    "agg_group",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
_add("agg_group_expr", "SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY extract(year FROM o_orderdate)")
_add("agg_group_alias", "SELECT CASE WHEN p_size < 25 THEN 'a' ELSE 'b' END AS half, count(*) AS n FROM part GROUP BY half")
_add("agg_global", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(avg(l_quantity), 6) AS avg_qty, min(l_shipdate) AS first_ship, max(l_extendedprice) AS top FROM lineitem")
_add("agg_empty", "SELECT count(*) AS n, count(o_orderkey) AS k, sum(o_totalprice) AS total, max(o_orderpriority) AS p FROM orders WHERE o_orderkey < 0")
_add("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 100000")
_add("agg_over_expr", "SELECT p_type, round(100.0 * sum(CASE WHEN p_size > 25 THEN p_retailprice ELSE 0 END) / sum(p_retailprice), 6) AS share FROM part GROUP BY p_type")
_add("agg_min_max_string", "SELECT c_mktsegment, min(c_name) AS first_name, max(c_name) AS last_name FROM customer GROUP BY c_mktsegment")
_add("agg_count_col", "SELECT s_nationkey, count(v) AS known, count(*) AS n FROM (SELECT s_nationkey, CASE WHEN s_acctbal > 5000 THEN s_acctbal END AS v FROM supplier) t GROUP BY s_nationkey")
_add("agg_sum_int", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS sizes, avg(p_size) AS mean_size FROM part GROUP BY p_brand")
_add("agg_null_group", "SELECT g, count(*) AS n FROM (SELECT CASE WHEN c_nationkey > 5 THEN c_nationkey END AS g FROM customer) t GROUP BY g")
_add("group_no_agg", "SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("agg_ratio_of_sums", "SELECT l_suppkey, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 8) AS ratio FROM lineitem GROUP BY l_suppkey")

# -- order, limit -------------------------------------------------------------------------

_add("order_multi", "SELECT c_mktsegment, c_nationkey, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_nationkey, c_custkey")
_add(
    "order_nulls",
    "SELECT k, v FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 END AS v FROM supplier) t ORDER BY v DESC, k LIMIT 30",
    "SELECT k, v FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 END AS v FROM supplier) t ORDER BY v DESC NULLS FIRST, k LIMIT 30",
)
_add("order_alias_agg", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 15")
_add("order_expression", "SELECT p_partkey FROM part ORDER BY p_partkey % 10 DESC, p_retailprice * 2, p_partkey LIMIT 25")
_add("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
QUERIES["topk_frame"] = frames.topk_frame
ORACLE_SQL["topk_frame"] = "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20"

# -- TPC-H shapes on these tables ---------------------------------------------------------

_add(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
        round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
_add(
    "tpch_q3",
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(o_orderdate AS DATE) AS o_date
    FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
        AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_date, l_orderkey LIMIT 10""",
)
_add(
    "tpch_q4",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-07-01' + INTERVAL '3' MONTH
        AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '30' DAY) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
)
_add(
    "tpch_q5",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
        AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '1' YEAR GROUP BY n_name ORDER BY revenue DESC""",
)
_add("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_add(
    "tpch_q7",
    """SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
        SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
        FROM supplier, lineitem, orders, customer, nation n1, nation n2
        WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
            AND ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3')) ) shipping
    GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
)
_add(
    "tpch_q8",
    """SELECT o_year, round(sum(CASE WHEN nation = 'NATION_5' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
        SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
        FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
        WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
            AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY' ) all_nations
    GROUP BY o_year ORDER BY o_year""",
)
_add(
    "tpch_q10",
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1996-10-01' + INTERVAL '3' MONTH
        AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
_add(
    "tpch_q12",
    """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_lines,
        CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_lines
    FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_linestatus ORDER BY l_linestatus""",
)
_add(
    "tpch_q13",
    "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1%' GROUP BY c_custkey) c_orders GROUP BY c_count ORDER BY custdist DESC, c_count DESC",
)
_add(
    "tpch_q14",
    """SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
    FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-09-01' + INTERVAL '1' MONTH""",
)
_add(
    "tpch_q15",
    """SELECT s_suppkey, s_name, total FROM supplier, (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01' GROUP BY l_suppkey) revenue
    WHERE s_suppkey = l_suppkey AND total = (SELECT max(t2) FROM (SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS t2 FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-04-01' GROUP BY l_suppkey) r2)""",
)
_add("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.4 * avg(b.l_quantity) FROM lineitem b WHERE b.l_partkey = p_partkey)")
_add(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_date, o_totalprice, round(sum(l_quantity), 2) AS quantity FROM customer, orders, lineitem
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 220) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
    GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
_add("tpch_q19", ORACLE_SQL["or_factoring"].replace("Brand#7", "Brand#15"))
_add(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
    WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
        AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
        AND s_nationkey = n_nationkey GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)
_add(
    "tpch_q22",
    """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
    WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_nationkey ORDER BY c_nationkey""",
)

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["queries_byte_bpe", "queries_licenses", "queries_line_dedup", "queries_mixing", "queries_piece_count", "queries_quality_classifier", "queries_quality_rules", "queries_simhash", "queries_topk", "queries_warc"]

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f".{_name}", __package__)
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)

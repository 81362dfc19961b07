"""All queries of the subpackage, by name, and the SQL they are held against where SQL can express them."""

from __future__ import annotations

from structmill.llm import p2_top_items, p3_syntax, p4_handwritten, p5_pairs, p6_leakage, p7_mixture, p8_truncation

_MODULES = (p2_top_items, p3_syntax, p4_handwritten, p5_pairs, p6_leakage, p7_mixture, p8_truncation)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}

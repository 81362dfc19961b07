"""All queries of the core, by name, and the SQL they are held against."""

from __future__ import annotations

from structmill.plans import documents, extraction, graph_keys, repository

_MODULES = (graph_keys, repository, extraction, documents)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
FLAGSHIP = repository.directory_profile

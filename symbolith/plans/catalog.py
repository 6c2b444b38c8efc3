"""All named queries and their DuckDB oracles, gathered from the plan modules."""

from __future__ import annotations

from . import analytics, code, condensing, extraction, outputs, project, references, symbols

MODULES = (symbols, code, extraction, project, references, outputs, condensing, analytics)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}

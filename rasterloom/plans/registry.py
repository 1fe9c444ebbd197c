"""All registered queries of the engine, by name."""

from __future__ import annotations

from . import core_queries, grid_queries, model_queries, more_queries, shape_queries

MODULES = (core_queries, grid_queries, model_queries, more_queries, shape_queries)
QUERIES = {name: f for m in MODULES for name, (f, _) in m.Q.items()}
ORACLE_SQL = {name: text for m in MODULES for name, (_, text) in m.Q.items() if text}

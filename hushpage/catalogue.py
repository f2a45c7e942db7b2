"""The query catalogue: name -> DataFrame builder, and name -> DuckDB SQL for the same rows."""

from __future__ import annotations

from hushpage.plans import action_queries, element_queries, html_queries, page_queries, text_queries, vision_queries

_MODULES = (text_queries, element_queries, html_queries, page_queries, vision_queries, action_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

"""Query name -> function and, where SQL can express it, the equivalent DuckDB SQL."""

from __future__ import annotations

from scryline.plans import flow_queries, operator_queries, persistence_queries, plan_queries, review_queries, search_queries, store_queries

_ALL = search_queries.QUERIES | review_queries.QUERIES | plan_queries.QUERIES | flow_queries.QUERIES | store_queries.QUERIES | operator_queries.QUERIES | persistence_queries.QUERIES
QUERIES = {name: f for name, (f, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}

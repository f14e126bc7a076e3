"""All registered queries and their SQL."""

from __future__ import annotations

from quillon.plans import analytics_queries, extra_queries, io_queries, object_queries, posterior_queries, relational_queries, spatial_queries

_MODULES = (spatial_queries, analytics_queries, relational_queries, posterior_queries, object_queries, io_queries, extra_queries)
_ALL = {name: pair for module in _MODULES for name, pair in module.PLANS.items()}
QUERIES = {name: f for name, (f, _) in _ALL.items()}
ORACLE = {name: sql for name, (_, sql) in _ALL.items() if sql}

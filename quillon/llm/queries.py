"""All queries of the corpus operators: name -> callable, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillon.llm import queries_basic, queries_models, queries_near, queries_search, queries_text

_MODULES = [queries_search, queries_text, queries_basic, queries_models, queries_near]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}

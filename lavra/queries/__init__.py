"""Queries by name, with their SQL."""

from __future__ import annotations

from lavra.queries import comparison, dataflow, flows, quality, relational, retrieval, survey

_MODULES = (quality, relational, dataflow, retrieval, comparison, survey, flows)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

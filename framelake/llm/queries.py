"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from . import q_documents, q_episodes

_MODULES = (q_episodes, q_documents)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}

"""Registered queries and their SQL, by name."""

from __future__ import annotations

from . import design, forest, inputs, lines, ranking, scalars, spatial

_ALL = scalars.QUERIES | lines.QUERIES | spatial.QUERIES | forest.QUERIES | ranking.QUERIES | inputs.QUERIES | design.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}

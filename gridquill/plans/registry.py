"""All queries of the engine's operators, and the SQL twin of each that has one."""

from __future__ import annotations

from gridquill.plans import choices, exposure, food, layers, library, session

_AREAS = (exposure, layers, choices, food, library, session)
QUERIES = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLE_SQL = {name: sql for area in _AREAS for name, sql in area.ORACLE_SQL.items()}

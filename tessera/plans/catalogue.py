"""Every query on the driver's tables, with the SQL that checks it."""

from __future__ import annotations

from tessera.plans import calls, datasets, evaluation, files, leaks, relational, retrieval, sketches

_PARTS = (evaluation, calls, retrieval, leaks, datasets, files, relational, sketches)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}

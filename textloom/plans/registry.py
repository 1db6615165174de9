"""Named queries and the SQL that states the same result."""

from __future__ import annotations

from . import oracles, queries

QUERIES = dict(queries.QUERIES)
ORACLES = oracles.oracles(queries.CONSTANTS)

"""All registered queries of the engine with their SQL equivalents."""

from __future__ import annotations

from .registry import ORACLE_SQL, QUERIES
from .suite import aggregates, chunking, guards, joins, more, office, procedures, replies, retrieval, routes, salvage, scalars, sinks, sources, sqlsurface, stateful, steps, streams, values, windows

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "chunking", "guards", "joins", "more", "office", "procedures", "replies", "retrieval", "routes", "salvage", "scalars", "sinks", "sources", "sqlsurface", "stateful", "steps", "streams", "values", "windows"]

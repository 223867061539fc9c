"""All registered queries of the engine."""

from __future__ import annotations

from tempoframe.plans import beat_queries, compare_queries, file_queries, signal_queries, track_queries

_MODULES = [beat_queries, compare_queries, track_queries, file_queries, signal_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}

"""Every query of the library proper, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from parlance.plans import attribution_queries, bank_queries, dataset_queries, discovery_queries, evidence_queries, graph_queries, model_queries, pool_queries, scalar_queries, sequence_queries

_PARTS = (sequence_queries, scalar_queries, bank_queries, attribution_queries, dataset_queries, evidence_queries, discovery_queries, pool_queries, graph_queries, model_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.SQL.items()}

"""All queries of the engine by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from chartloom.plans import corpus_queries, dataset_queries, evaluation_queries, event_queries, extraction_queries, fact_queries, file_queries, insight_queries, merge_queries, mining_queries, report_queries, rollup_queries, session_queries, source_queries, training_queries

_MODULES = (insight_queries, evaluation_queries, dataset_queries, corpus_queries, event_queries, extraction_queries, fact_queries, file_queries, merge_queries, mining_queries, report_queries, rollup_queries, session_queries, source_queries, training_queries)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}

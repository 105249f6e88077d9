"""All queries of the library, without those of the subpackage llm."""

from __future__ import annotations

from tessitura.plans import compare_queries, evaluation_queries, general_queries, mart_queries, media_queries, model_queries, relation_queries, run_queries, sequence_queries, service_queries, storage_queries

_MODULES = [general_queries, compare_queries, evaluation_queries, sequence_queries, mart_queries, media_queries, model_queries, relation_queries, run_queries, service_queries, storage_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}

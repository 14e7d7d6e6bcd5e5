"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marrowlake.plans import evaluation_queries, graph_queries, incremental_queries, index_queries, operation_queries, retrieval_queries, source_queries, text_queries

_MODULES = (incremental_queries, text_queries, retrieval_queries, graph_queries, evaluation_queries, index_queries, source_queries, operation_queries,)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}


def flagship(spark: SparkSession, base: str) -> DataFrame:
    return QUERIES["hybrid_tier1"](spark, base)

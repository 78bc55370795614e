"""Registered queries of the retrieval and corpus operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import chunk_queries, corpus_queries, graph_queries, operations_queries, plugin_queries, retrieval_queries, stream_queries  # noqa: F401
from corpusmill.plans.registry import ORACLE, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chunks answer each benchmark text, best first."""
    return QUERIES["answer_contexts"](spark, sf_dir)

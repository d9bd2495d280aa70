"""All queries outside the llm package, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import data_queries, graph_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.q_table_by_ship(spark, sf_dir)


def queries() -> dict:
    return graph_queries.QUERIES | data_queries.queries()


def oracle_sql() -> dict:
    return graph_queries.SQL | data_queries.oracle_sql()

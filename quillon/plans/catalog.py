"""Registered queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir)`` under its name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import corpus_queries, record_queries, rule_queries, table_queries, text_queries, value_queries, verdict_queries  # noqa: E402, F401

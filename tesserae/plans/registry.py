"""Queries of the core and their SQL, by name. Each query takes (spark, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators.packed import known_values, split_packed
from tesserae.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where there is one."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "question_records"), "row_id", ["c6", "c7"])


@query("p3_known_values")
def p3_known_values(spark: SparkSession, d: str) -> DataFrame:
    return known_values(table(spark, d, "question_records").select("row_id", "c6", "c7").dropDuplicates(["row_id"]), ["c6", "c7"])

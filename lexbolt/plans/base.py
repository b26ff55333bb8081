"""Where queries are registered, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbolt.sources.readers import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def made(spark: SparkSession, sf_dir: str, name: str, **columns: str) -> DataFrame:
    """Rows of a table with columns by SQL expressions: inputs of grammars are written from
    the table's values, so that plain SQL can say what must come out."""
    return table(spark, sf_dir, name).select(*[F.expr(e).alias(c) for c, e in columns.items()])

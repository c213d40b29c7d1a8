"""Registry of the queries we ship: name -> (spark callable, oracle SQL).

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
given tables. The oracle SQL is an independent DuckDB formulation over the
same tables (views named like the parquet files); ML jobs have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query. ``sql`` may be a function: it is then built only when
    ``oracle_sql()`` asks, so one bad oracle cannot take the registry down."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def docs(spark: SparkSession, sf_dir: str, where=None) -> DataFrame:
    """``documents`` (optionally filtered first). Splits are the scan's own
    (``spark.sql.files.maxPartitionBytes``): texts are never shuffled to
    spread them."""
    d = t(spark, sf_dir, "documents")
    return d.filter(where) if where is not None else d


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``, dealt by document before the texts are cut: terms are
    then counted and weighted where their document is, and texts, the smallest
    form, cross the shuffle instead of a row for each term."""
    return docs(spark, sf_dir).select("doc_id", "text").repartition("doc_id")


def load_all() -> None:
    from . import aggregates, flows, ingest, joins, learning, scalars, text, windows  # noqa: F401


def oracle_text(name: str) -> str:
    sql = ORACLE[name]
    return sql() if callable(sql) else sql

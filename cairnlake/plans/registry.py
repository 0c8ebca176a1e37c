"""Queries of the catalog engine, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnlake.sources.catalog import BASE_SQL, Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Catalog as a query; sql follows the catalog's tables, and may begin with more of them."""

    def register(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if sql:
            body = sql.strip()
            ORACLE_SQL[name] = BASE_SQL + (", " + body[5:] if body.startswith("WITH ") else body)
        return f

    return register


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: keyword and vector lists fused by reciprocal rank."""
    return QUERIES["hybrid_search"](spark, sf_dir)


from cairnlake.plans.queries import facts, files, graphs, organizing, retrieval, takes  # noqa: E402, F401

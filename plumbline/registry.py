"""All queries of the engine, and the SQL that says what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import catalog_queries, geometry_queries, job_queries, text_queries, viewer_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**geometry_queries.QUERIES, **catalog_queries.QUERIES, **job_queries.QUERIES, **text_queries.QUERIES, **viewer_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**geometry_queries.SQL, **catalog_queries.SQL, **job_queries.SQL, **text_queries.SQL, **viewer_queries.SQL}

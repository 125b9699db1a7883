"""Registration of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import for_duckdb
from .views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register ``f(tables) -> DataFrame`` under a key; ``sql`` is its oracle, headed by the views it names."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            head = with_views(*views.split()) if views else ""
            body = for_duckdb(sql.strip())
            if head and body.upper().startswith("WITH RECURSIVE "):
                head, body = head.replace("WITH ", "WITH RECURSIVE ", 1), "," + body[14:]
            elif head and body.upper().startswith("WITH "):
                body = "," + body[4:]
            ORACLES[name] = f"{head}{body if body.startswith(',') else ' ' + body}"
        return f

    return put

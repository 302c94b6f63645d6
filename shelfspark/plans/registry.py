"""Named queries: a function of (spark, sf_dir), and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a plan over Tables; its SQL may use the domain views, and further common table expressions before a line `==`."""

    def add(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql:
            more, _, main = sql.rpartition("\n==\n")
            SQL[name] = f"WITH RECURSIVE {SQL_VIEWS.strip()}{',' + more if more else ''}\n{main}" if views else sql
        return plan

    return add

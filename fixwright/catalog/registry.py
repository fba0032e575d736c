"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, workspace

QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query on a workspace, with the SQL that must give the same rows."""

    def add(fn: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r6(col: str | Column, name: str | None = None) -> Column:
    """A measure rounded to six places under its own name."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6).alias(name or (col.split(".")[-1] if isinstance(col, str) else "value"))


def price6(col: str | Column, name: str | None = None) -> Column:
    """A price of at most twelve places rounded half up to six, whatever the last bits of its double; ``price6_sql`` is the same in SQL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("decimal(38,12)"), 6).cast("double").alias(name or (col.split(".")[-1] if isinstance(col, str) else "value"))


def price6_sql(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38,12)), 6) AS DOUBLE)"


def day(col: str = "index_date", name: str | None = None) -> Column:
    return F.date_format(col, "yyyy-MM-dd").alias(name or col)


def runner(name: str):
    """The query as (spark, sf_dir) -> DataFrame."""

    def run(spark, sf_dir: str) -> DataFrame:
        return QUERIES[name](workspace(spark, sf_dir))

    run.__name__ = name
    return run

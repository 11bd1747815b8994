"""Names of the queries, the functions that plan them and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidings.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a plan ``fn(views) -> DataFrame`` under ``name`` with its SQL."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register


def stamp(column) -> Column:
    """Time as text to the second, the same in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def sql_stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def six(column) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)

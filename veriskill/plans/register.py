"""Decorator that registers a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriskill.plans.fixtures import view, with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(*names: str, sql: str | None = None):
    """``f(spark, *views)`` as the query named like ``f`` over the named views; ``sql`` is completed with these views."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, *(view(spark, sf_dir, n) for n in names))
        if sql:
            SQL[f.__name__] = with_views(sql, *names)
        return f

    return add


def rounded(df: DataFrame, digits: int = 4, offset: float = 0.0) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; -0.0 becomes 0.0.

    Where exact results often end on a half, a small ``offset`` (also in the SQL) rounds them alike everywhere.
    """
    def one(name: str, kind: str) -> Column:
        return (F.round(F.col(f"`{name}`") + offset, digits) + 0.0).alias(name) if kind == "double" else F.col(f"`{name}`")

    return df.select(*(one(*x) for x in df.dtypes))

"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def num(value: float) -> str:
    """Floating literal both engines read as DOUBLE."""
    return f"{float(value)!r}e0" if "e" not in repr(float(value)) else repr(float(value))


class _Columns:
    """`c.name` is `F.col("name")`, made when used: a Column needs a session and modules load before one exists."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = _Columns()

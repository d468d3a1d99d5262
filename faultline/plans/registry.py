"""Where the plan modules put their queries and the SQL each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return register


def joined(c: str | Column, out: str | None = None) -> Column:
    """Array shown as text, for comparison."""
    col = F.array_join(c, "|", "~")
    name = out or (c if isinstance(c, str) else None)
    return col.alias(name) if name else col


def stamp(c: str | Column, out: str | None = None) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(out or c)


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]

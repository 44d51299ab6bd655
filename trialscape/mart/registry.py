"""Registered queries and the SQL each one must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def cte(name: str, body: str) -> None:
    """Name a common table expression; it may use those named before it."""
    CTES[name] = body


def with_ctes(body: str) -> str:
    """The statement preceded by the expressions it needs."""
    needed: set[str] = set()
    texts = [body]
    while texts:
        text = texts.pop()
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                texts.append(definition)
    chosen = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    return ("WITH " + ",\n".join(chosen) + "\n" if chosen else "") + body


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})

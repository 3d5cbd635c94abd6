"""Named queries over the given tables, each with its DuckDB form where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a query under ``name``; ``ids`` lists the inventory rows it covers."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name], IDS[name] = fn, ids
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), dates as midnights, counts as bigint, for comparison across engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.round(c, digits) + F.lit(0.0)
        elif kind == "date":
            c = c.cast("timestamp_ntz")
        elif kind in ("int", "smallint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)

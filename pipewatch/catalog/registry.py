"""Registration of named queries and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewatch.session import tune
from pipewatch.sources.views import VIEWS, duckdb_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Shared sub-queries of the checking SQL, in order of dependence.
CTES: dict[str, str] = dict(VIEWS)


def oracle_text(body: str) -> str:
    """The SQL with a WITH clause for every shared sub-query it reaches."""
    needed: set[str] = set()

    def reach(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                reach(CTES[name])

    reach(body)
    body = body.strip()
    parts = [f"{name} AS ({sql.strip()})" for name, sql in CTES.items() if name in needed]
    if body[:5].upper() == "WITH ":
        parts.append(body[5:])
        return duckdb_text("WITH " + ",\n".join(parts))
    return duckdb_text(("WITH " + ",\n".join(parts) + "\n" if parts else "") + body)


def plain(df: DataFrame) -> DataFrame:
    """Times without zone, as in the driver's tables."""
    return df.select(
        *[
            F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its checking SQL if any."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(tune(spark), sf_dir))

        run.__doc__ = fn.__doc__
        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle_text(sql)
        return fn

    return register

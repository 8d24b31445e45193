"""Registered queries, each with the SQL that gives the same rows where SQL can."""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum import session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _shipped(run: Query) -> Query:
    @functools.wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(session.ship(spark), sf_dir)
    return shipped


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if run.__name__ in QUERIES:
            raise ValueError(f"two queries are named {run.__name__}")
        QUERIES[run.__name__] = _shipped(run)
        if sql:
            ORACLES[run.__name__] = sql
        return run
    return add

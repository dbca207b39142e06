"""Where queries are registered, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.plans.views import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of ``Views`` under its name without the leading ``q_``."""

    def keep(f: Callable[[Views], DataFrame]):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = lambda spark, folder: f(Views(spark, folder))
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return keep

"""Catalogue of named queries: callable and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.plans import q_audit, q_core, q_delta_gate, q_families, q_gaps, q_nested, q_release, q_repeats, q_rows, q_select, q_stats  # noqa: F401  importing registers
from orrery.plans.registry import ORACLES, QUERIES
from orrery.plans.views import Views

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank metrics of every receptor from raw poses."""
    return q_core.q_metric_bundle(Views(spark, sf_dir))

"""Data-quality constraints that fail closed.

``audit`` evaluates many row conditions in one pass and gives a table of violations;
``enforce`` raises on the driver if there are any.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class AuditError(ValueError):
    """A constraint does not hold."""


def audit(df: DataFrame, **violations: Column) -> DataFrame:
    """``constraint, n_violations, passed`` of row conditions that must never hold."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in violations.items()])
    rows = counts.unpivot([], list(violations), "constraint", "n_violations")
    return rows.withColumn("passed", F.col("n_violations") == 0)


def enforce(audited: DataFrame) -> None:
    failed = audited.filter(~F.col("passed")).orderBy("constraint").collect()
    if failed:
        raise AuditError("; ".join(f"{r['constraint']}: {r['n_violations']}" for r in failed))


def require(df: DataFrame, condition: Column, what: str) -> DataFrame:
    """``df``, in which every row must meet ``condition``; the task fails otherwise."""
    message = F.raise_error(F.lit(f"missing {what}"))
    keep = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(message.cast("boolean"))
    return df.filter(keep)


def count_is(df: DataFrame, expected: int) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit("row_count").alias("constraint"), F.abs(F.col("n") - expected).alias("n_violations"), (F.col("n") == expected).alias("passed"))


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = df.groupBy(*keys).count().agg(F.count_if(F.col("count") > 1).alias("n"))
    return n.select(F.lit("unique_key").alias("constraint"), F.col("n").alias("n_violations"), (F.col("n") == 0).alias("passed"))


def partition_audit(a: DataFrame, b: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """How far ``a`` and ``b`` are from a partition of ``full``: shared, missing and extra keys."""
    side = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(1))
    every = side(a, "a").join(side(b, "b"), key, "full").join(side(full, "f"), key, "full")
    in_part = F.col("a").isNotNull() | F.col("b").isNotNull()
    return every.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"),
        F.count_if(F.col("f").isNotNull() & ~in_part).alias("missing"),
        F.count_if(F.col("f").isNull() & in_part).alias("extra"),
    )


def crossing_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that lie in more than one fold."""
    n = df.groupBy(group).agg(F.count_distinct(fold).alias("fold_count"))
    return n.filter("fold_count > 1")


def mismatches(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows whose stored value is not the recomputed one, within a tolerance, or that lack a partner."""
    new = recomputed.select(*keys, F.col(value).alias("__v"))
    both = stored.select(*keys, value).join(new, list(keys), "full")
    same = F.abs(F.col(value) - F.col("__v")) <= tolerance
    return both.filter(~F.coalesce(same, F.lit(False))).select(*keys, value, F.col("__v").alias("recomputed"))

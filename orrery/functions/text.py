"""Expressions over names, text records and nested columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def blank_to(c: Column, value: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(value))


def safe_file_name(c: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` stay; anything else becomes ``_``."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_")


def forward_slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def tolerant_double(c: Column) -> Column:
    """A number, or null for blank and malformed cells."""
    return c.try_cast("double")


def tolerant_int(c: Column) -> Column:
    """Truncated as a number: ``1.0`` is 1."""
    return c.try_cast("double").cast("int")


def is_true(c: Column) -> Column:
    return F.lower(F.trim(c)) == "true"


def flatten(df: DataFrame, structs: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Fields of struct columns as ``<column>_<field>``."""
    fields = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in structs for f in df.schema[s].dataType.names]
    return df.select(*keys, *fields)


def first_block(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ends: Column) -> DataFrame:
    """Rows of each key before the first that ``ends`` the block."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("__b", F.sum(F.when(ends, 1).otherwise(0)).over(w)).filter("__b = 0").drop("__b")

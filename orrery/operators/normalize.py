"""Scaling of scores and terms. Bounds come from training rows only and are never clipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def bounds(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(score).alias("lower"), F.max(score).alias("upper"))


def apply_bounds(df: DataFrame, frozen: DataFrame, keys: Sequence[str], score: str = "score", constant: float = 0.0) -> DataFrame:
    """Scores between the bounds of their key; a key without spread gives ``constant``."""
    out = df.join(frozen, list(keys))
    width = F.col("upper") - F.col("lower")
    scaled = F.when(width == 0, F.lit(constant)).otherwise((F.col(score) - F.col("lower")) / width)
    return out.withColumn("normalized", scaled).drop("lower", "upper")


def minmax(value: str, keys: Sequence[str], constant: float = 0.0) -> Column:
    """Min-max over the rows of a key: terms take 0 where all are alike, utilities 0.5."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, F.lit(constant)).otherwise((F.col(value) - low) / (high - low))


def maxabs(value: str, keys: Sequence[str]) -> Column:
    """Scaled by the largest absolute value; signs stay, and all zeros stay zero."""
    top = F.max(F.abs(value)).over(Window.partitionBy(*keys))
    return F.when(top == 0, F.lit(0.0)).otherwise(F.col(value) / top)


def standardize(long: DataFrame, feature: str, value: str, least_std: float = 1e-12) -> DataFrame:
    """Z-scores by feature with the population deviation; features without spread are dropped."""
    w = Window.partitionBy(feature)
    std = F.stddev_pop(value).over(w)
    out = long.withColumns({"__m": F.avg(value).over(w), "__s": std}).filter(F.col("__s") > least_std)
    return out.withColumn("z", (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def impute_median(long: DataFrame, feature: str, value: str) -> DataFrame:
    """Missing values take the median of their feature."""
    medians = long.groupBy(feature).agg(F.median(value).alias("__median"))
    out = long.join(medians, feature)
    return out.withColumn(value, F.coalesce(value, "__median")).drop("__median")

"""Grouped summaries of replicates, ensembles and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators.relational import reason_flags


def seed_stability(
    scores: DataFrame,
    keys: Sequence[str],
    replicate: str,
    score: str,
    max_range: float,
    max_median_delta: float,
    least_favorable: int,
) -> DataFrame:
    """Replicates of a key with the reasons why they do not agree.

    The best replicate is the first in replicate order among equal minima.
    """
    out = scores.groupBy(*keys).agg(
        F.min(score).alias("minimum_score"),
        F.median(score).alias("median_score"),
        F.max(score).alias("maximum_score"),
        F.count_if(F.col(score) < 0).alias("favorable_replicate_count"),
        F.count(F.lit(1)).alias("replicate_count"),
        F.min_by(replicate, F.struct(score, replicate)).alias("best_replicate_id"),
    )
    spread = F.col("maximum_score") - F.col("minimum_score")
    lift = F.col("median_score") - F.col("minimum_score")
    reasons = reason_flags(
        seed_range_exceeded=spread > max_range,
        minimum_median_delta_exceeded=lift > max_median_delta,
        insufficient_favorable_replicates=F.col("favorable_replicate_count") < least_favorable,
        nonnegative_minimum_score=F.col("minimum_score") >= 0,
    )
    out = out.withColumns({"seed_range": F.round(spread, 6), "minimum_median_delta": F.round(lift, 6), "reasons": reasons})
    return out.withColumn("warning", F.col("reasons") != "")


def consensus_count(scores: DataFrame, keys: Sequence[str], score: str, delta: float) -> DataFrame:
    """How many replicates of a key come within ``delta`` of its best, and the spread, in one pass."""
    values = scores.groupBy(*keys).agg(F.collect_list(score).alias("v"))
    near = F.size(F.filter("v", lambda x: x <= F.array_min("v") + delta))
    return values.select(*keys, near.alias("consensus_replicate_count"), (F.array_max("v") - F.array_min("v")).alias("score_range"))


def ensemble(scores: DataFrame, keys: Sequence[str], how: str, score: str = "score") -> DataFrame:
    """One score per key over the receptors that are there: ``min_score`` or ``mean_score``."""
    made = {"min_score": F.min(score), "mean_score": F.avg(score)}[how]
    return scores.groupBy(*keys).agg(made.alias("score"))


def summary(value: str) -> list[Column]:
    """Mean, population deviation, extremes and number of positive values."""
    return [
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("population_std"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.count_if(F.col(value) > 0).alias("positive_count"),
    ]


def distribution(value: str) -> list[Column]:
    """Extremes, 5th and 95th percentile (linear), median, mean and population deviation."""
    return [
        F.min(value).alias("min"),
        F.percentile(value, 0.05).alias("q05"),
        F.median(value).alias("median"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("population_std"),
        F.percentile(value, 0.95).alias("q95"),
        F.max(value).alias("max"),
    ]


def nearest_rank(value: str, p: float) -> Column:
    """The value at position ceil(p n) of the sorted values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def ecdf(value: str, target: str) -> Column:
    return F.avg((F.col(value) <= F.col(target)).cast("double"))


def runs(frames: DataFrame, run: str, frame: str, cluster: str) -> DataFrame:
    """Islands of consecutive frames in one cluster: gaps fall where frame minus row number changes."""
    n = F.row_number().over(Window.partitionBy(run, cluster).orderBy(frame))
    return frames.withColumn("__island", F.col(frame) - n).groupBy(run, cluster, "__island").agg(
        F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count(F.lit(1)).alias("length")
    ).drop("__island")


def temporal_runs(frames: DataFrame, run: str, frame: str, cluster: str) -> DataFrame:
    """Per cluster of a run: size, extent, number of islands, the longest, and whether it was left and met again."""
    return runs(frames, run, frame, cluster).groupBy(run, cluster).agg(
        F.sum("length").alias("size"),
        F.min("first_frame").alias("first_frame"),
        F.max("last_frame").alias("last_frame"),
        F.count(F.lit(1)).alias("run_count"),
        F.max("length").alias("longest_run"),
        (F.count(F.lit(1)) > 1).alias("revisited"),
    )


def late_window(frames: DataFrame, run: str, frame: str, value: str, last: int) -> DataFrame:
    """Mean, first, final and slope of the last frames of each run."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(F.desc(frame)))
    late = frames.withColumn("__n", n).filter(F.col("__n") <= last)
    return late.groupBy(run).agg(
        F.count(F.lit(1)).alias("frames"),
        F.avg(value).alias("mean"),
        F.min_by(value, frame).alias("first"),
        F.max_by(value, frame).alias("final"),
        F.regr_slope(value, frame).alias("slope"),
    )

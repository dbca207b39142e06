"""Bootstrap intervals: draws are rows keyed by iteration, metrics one grouped query over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators.ranking import metrics


#: Units are numbered in so many buckets, so that no task sees them all.
BUCKETS = 1024


def numbered(units: DataFrame, unit: str, strata: Sequence[str] = ()) -> DataFrame:
    """``unit, *strata, __at, __n``: each unit's number within its stratum, from 0 on, and how many there are."""
    rows = units.select(unit, *strata, F.pmod(F.xxhash64(unit), F.lit(BUCKETS)).alias("__b"))
    counts = rows.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__c"))  # a row per bucket and stratum
    by = Window.partitionBy(*strata)
    before = F.sum("__c").over(by.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*strata, "__b", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__c").over(by).alias("__n"))
    rank = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy(unit)) - 1
    out = rows.withColumn("__r", rank).join(counts, [*strata, "__b"])
    return out.select(unit, *strata, (F.col("__before") + F.col("__r")).cast("int").alias("__at"), "__n")


def draws(units: DataFrame, unit: str, iterations: int, seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """``iteration, draw, unit``: as many units per iteration (and stratum) as there are, with replacement.

    The position drawn is a hash of seed, iteration, stratum and draw.
    """
    every = numbered(units, unit, strata)
    asked = every.select(*strata, F.col("__at").alias("draw"), "__n", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    at = F.pmod(F.xxhash64(F.lit(seed), "iteration", "draw", *strata), F.col("__n"))
    asked = asked.withColumn("__at", at.cast("int")).drop("__n")
    return asked.join(every.drop("__n"), [*strata, "__at"]).select("iteration", "draw", unit, *strata)


def resampled(scores: DataFrame, drawn: DataFrame, unit: str, id_: str = "ligand_id") -> DataFrame:
    """Scores of the drawn units; each draw counts as a row of its own."""
    return scores.join(drawn.select("iteration", "draw", unit), unit).withColumn(
        "draw_id", F.concat_ws("__", F.col(id_).cast("string"), F.col("draw").cast("string"))
    )


def interval(values: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval over the iterations whose value is defined; the others are counted as skipped.

    Values, one per iteration, are added in their order, so the mean does not depend on how rows arrive.
    """
    ok = F.when(~F.isnan(value), F.col(value))
    total = F.aggregate(F.array_sort(F.collect_list(ok)), F.lit(0.0), lambda a, x: a + x)
    tail = (1 - level) / 2
    return values.groupBy(*keys).agg(
        F.count(ok).alias("used"),
        F.count_if(F.isnan(value)).alias("skipped"),
        F.when(F.count(ok) > 0, total / F.count(ok)).alias("mean"),
        F.percentile(ok, tail).alias("lower"),
        F.percentile(ok, 1 - tail).alias("upper"),
    )


def bootstrap(scores: DataFrame, keys: Sequence[str], metric: str, iterations: int, seed: int, unit: str = "ligand_id", strata: Sequence[str] = ()) -> DataFrame:
    """Interval of one metric per key. With a group column as ``unit`` whole groups are drawn."""
    units = scores.select(unit, *strata).distinct()
    rows = resampled(scores, draws(units, unit, iterations, seed, strata), unit)
    found = metrics(rows, [*keys, "iteration"], id_="draw_id", top=0)
    return interval(found, keys, metric)


def paired_delta(scores: DataFrame, key: str, a, b, metric: str, iterations: int, seed: int, unit: str = "ligand_id") -> DataFrame:
    """Interval of metric(b) - metric(a) on the same draws; iterations where either is undefined are skipped."""
    units = scores.select(unit).distinct()
    rows = resampled(scores.filter(F.col(key).isin(a, b)), draws(units, unit, iterations, seed), unit)
    found = metrics(rows, [key, "iteration"], id_="draw_id", top=0)
    of = lambda x: F.max(F.when(F.col(key) == x, F.col(metric)))
    delta = found.groupBy("iteration").agg((of(b) - of(a)).alias("delta")).withColumn("pair", F.lit(f"{b}-{a}"))
    return interval(delta, ["pair"], "delta")

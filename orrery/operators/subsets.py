"""Subsets of scorers: enumeration, quadratic objectives, exact and greedy selection.

Pools are small (up to about 20 scorers), so subsets are numbers whose bits are the
members; every objective is a join of the subset table with coefficient rows. Costs grow
with subsets times rows, never with pairs of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

MAX_POOL = 20


def k_subsets(spark: SparkSession, members: Sequence, sizes: Sequence[int] | None = None) -> DataFrame:
    """``mask, size, subset`` of the non-empty subsets with one of ``sizes``; members in their order."""
    if len(members) > MAX_POOL:
        raise ValueError(f"at most {MAX_POOL} members can be enumerated")
    masks = spark.range(1, 1 << len(members)).select(F.col("id").alias("mask"), F.bit_count("id").alias("size"))
    if sizes is not None:
        masks = masks.filter(F.col("size").isin(list(sizes)))
    kept = [F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.lit(m)) for i, m in enumerate(members)]
    return masks.withColumn("subset", F.array_compact(F.array(*kept)))


def subset_name(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "+")


def inclusion_frequency(subsets: DataFrame, column: str) -> DataFrame:
    """``member, n, frequency`` over the rows of subsets. Counting rows costs one small aggregate."""
    total = subsets.agg(F.count(F.lit(1)).alias("__t"))
    n = subsets.select(F.explode(column).alias("member")).groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(total)).select("member", "n", (F.col("n") / F.col("__t")).alias("frequency"))


def consensus_core(frequencies: DataFrame, least: float) -> DataFrame:
    """Members at least so frequent, the most frequent first."""
    return frequencies.filter(F.col("frequency") >= least - 1e-12).orderBy(F.desc("n"), "member")


def subset_scores(scores: DataFrame, subsets: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """One score per subset and row key: minimum or mean over the members."""
    members = subsets.select("mask", F.explode("subset").alias("receptor_id"))
    made = {"min_score": F.min("score"), "mean_score": F.avg("score")}[how]
    return scores.join(F.broadcast(members), "receptor_id").groupBy("mask", *keys).agg(made.alias("score"))


def energies(subsets: DataFrame, linear: DataFrame, quadratic: DataFrame, constant: Column | float) -> DataFrame:
    """``mask, subset, energy`` under c + sum of h_i x_i + sum of J_ij x_i x_j.

    ``linear``: member, h. ``quadratic``: a, b, j with a before b. Coefficients go by
    broadcast, as there are at most as many as pairs of a pool.
    """
    h = subsets.select("mask", F.explode("subset").alias("member")).join(F.broadcast(linear), "member").groupBy("mask").agg(F.sum("h").alias("h"))
    pairs = subsets.join(F.broadcast(quadratic), F.array_contains("subset", F.col("a")) & F.array_contains("subset", F.col("b")))
    j = pairs.groupBy("mask").agg(F.sum("j").alias("j"))
    c = constant if isinstance(constant, Column) else F.lit(float(constant))
    out = subsets.join(h, "mask").join(j, "mask", "left")
    return out.select("mask", "size", "subset", (c + F.col("h") + F.coalesce("j", F.lit(0.0))).alias("energy"))


def best_subset(energy: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The subset of least energy per key; ties go to the first in the order of members."""
    order = F.struct(F.round("energy", 9), F.col("subset"))
    best = energy.groupBy(*keys).agg(F.min_by(F.struct("subset", "energy"), order).alias("b"))
    return best.select(*keys, "b.subset", "b.energy")


def coefficients(
    unary: DataFrame, pairs: DataFrame, target_size: int, size_penalty: float, unary_weights: dict[str, float], pair_weights: dict[str, float], count_weight: float = 0.0
) -> tuple[DataFrame, DataFrame, float]:
    """Linear rows, quadratic rows and the constant of weighted terms plus a size penalty.

    Term columns enter with their weights' signs; the penalty P (|x| - k)^2 spreads over
    the constant (P k^2), the linear part (P (1 - 2 k)) and the quadratic part (2 P).
    """
    if not target_size >= 1 or size_penalty <= 0:
        raise ValueError("target size and size penalty must be positive")
    h = sum((F.col(t) * w for t, w in unary_weights.items()), F.lit(count_weight + size_penalty * (1 - 2 * target_size)))
    j = sum((F.col(t) * w for t, w in pair_weights.items()), F.lit(2.0 * size_penalty))
    return unary.select("member", h.alias("h")), pairs.select("a", "b", j.alias("j")), size_penalty * target_size**2


def greedy_forward(candidates: Sequence, size: int, value) -> list:
    """Adds, ``size`` times, the member with the highest ``value`` of the grown subset.

    ``value`` takes a list of subsets and gives a number for each, so each round is one
    job over all candidates. Ties go to the first candidate.
    """
    chosen: list = []
    for _ in range(min(size, len(candidates))):
        rest = [c for c in candidates if c not in chosen]
        values = value([sorted([*chosen, c]) for c in rest])
        chosen.append(max(zip(rest, values, strict=True), key=lambda x: (x[1], -rest.index(x[0])))[0])
    return sorted(chosen)


def with_members(subsets: DataFrame, required: Sequence) -> DataFrame:
    """The subsets that hold all required members."""
    for m in required:
        subsets = subsets.filter(F.array_contains("subset", F.lit(m)))
    return subsets


def lower_bound(linear: DataFrame, quadratic: DataFrame, size: int, penalty: float) -> DataFrame:
    """``least``: no subset of another size than ``size`` has less energy.

    A subset of s members pays the penalty of s and, at best, the s least linear terms and
    the s (s - 1) / 2 least quadratic terms, both without their share of the penalty. The
    tables have a row per member and per pair.
    """
    upto = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h, j = F.col("h") - penalty * (1 - 2 * size), F.col("j") - 2.0 * penalty
    h_sums = linear.select(F.row_number().over(Window.orderBy("h", "member")).alias("s"), F.sum(h).over(upto("h", "member")).alias("hs"))
    j_sums = quadratic.select(F.row_number().over(Window.orderBy("j", "a", "b")).alias("p"), F.sum(j).over(upto("j", "a", "b")).alias("js"))
    none = linear.sparkSession.createDataFrame([(0, 0.0)], "s int, hs double")
    sizes = none.unionByName(h_sums).filter(F.col("s") != size).withColumn("p", F.col("s") * (F.col("s") - 1) / 2)
    bound = penalty * (F.col("s") - size) * (F.col("s") - size) + F.col("hs") + F.coalesce("js", F.lit(0.0))
    return sizes.join(j_sums, "p", "left").agg(F.min(bound).alias("least"))


def parameter_grid(spark: SparkSession, values: dict[str, Sequence]) -> DataFrame:
    """A row for each combination of the named values."""
    from itertools import product

    return spark.createDataFrame(list(product(*values.values())), list(values))


def value_grid(*columns: DataFrame) -> DataFrame:
    """Every combination of the distinct values of frames with one column each; meant for columns of few values."""
    out = columns[0].distinct()
    for c in columns[1:]:
        out = out.crossJoin(c.distinct())
    return out

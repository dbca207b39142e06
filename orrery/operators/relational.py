"""Joins, groupings, set operations and pivots over score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def representative(poses: DataFrame, keys: Sequence[str], method: str = "pose_rank_1") -> DataFrame:
    """One row per key: the score that stands for its poses.

    ``pose_rank_1`` takes the first-ranked pose and falls back to the best one;
    ``min_score`` takes the best. Groups without a successful pose stay, as failed rows
    with null scores. One grouped pass without a window.
    """
    if method not in ("pose_rank_1", "min_score"):
        raise ValueError(f"unknown method: {method}")
    ok = (F.col("status") == "ok") & F.col("docking_score").isNotNull()
    order = F.struct("docking_score", "pose_rank")
    best = F.min(F.when(ok, order))
    first = F.min(F.when(ok & (F.col("pose_rank") == 1), order))
    chosen = F.coalesce(first, best) if method == "pose_rank_1" else best
    out = poses.groupBy(*keys).agg(
        chosen.alias("chosen"), best.alias("best"), F.count_if(ok).alias("pose_count")
    )
    return out.select(
        *keys,
        F.col("chosen.docking_score").alias("representative_score"),
        F.when(F.col("pose_count") > 0, "ok").otherwise("failed").alias("status"),
        "pose_count",
        F.col("chosen.pose_rank").alias("best_pose_rank"),
        F.col("best.docking_score").alias("best_docking_score"),
    )


def pivot_scores(long: DataFrame, keys: Sequence[str], column: str, values: Sequence, score: str) -> DataFrame:
    """Long to wide with one column per value; missing cells are null.

    The values are given, so that no extra job has to find them.
    """
    return long.groupBy(*keys).pivot(column, list(values)).agg(F.max(score))


def unpivot_scores(wide: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, score: str) -> DataFrame:
    return wide.unpivot(list(keys), list(columns), name, score)


def seed_aggregate(scores: DataFrame, keys: Sequence[str], seed: str, seeds: Sequence[int], score: str) -> DataFrame:
    """Replicates per key side by side, with minimum, median and maximum; only complete keys."""
    per_seed = [F.max(F.when(F.col(seed) == s, F.col(score))).alias(f"s{s}") for s in seeds]
    out = scores.groupBy(*keys).agg(
        *per_seed,
        F.min(score).alias("lo"),
        F.median(score).alias("mid"),
        F.max(score).alias("hi"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.filter(F.col("n") == len(seeds)).drop("n")


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with ``side``; empty if the key sets are equal."""
    left = a.select(*keys).distinct().withColumn("in_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, list(keys), "full").filter(F.col("in_a").isNull() | F.col("in_b").isNull())
    return both.select(*keys, F.when(F.col("in_a").isNull(), "b").otherwise("a").alias("side"))


def strict_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that refuses unequal key sets."""
    if not key_difference(a, b, keys).isEmpty():
        raise ValueError("the two sides do not have the same keys")
    return a.join(b, list(keys))


def override(base: DataFrame, replacement: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """``base`` with scores replaced where ``replacement`` has one, and where each came from."""
    new = replacement.select(*keys, F.col(score).alias("__new"))
    out = base.join(new, list(keys), "left")
    origin = F.when(F.col("__new").isNotNull(), "replacement").otherwise("base").alias("origin")
    return out.select(*keys, F.coalesce("__new", score).alias(score), origin)


def expected_grid(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Every row key with every column key. The column side is a list of scorers."""
    return rows.crossJoin(columns)


def disjoint_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union that refuses keys that occur twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not out.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} occurs more than once")
    return out


def tagged_union(parts: dict[str, DataFrame], tag: str) -> DataFrame:
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def distinct_first(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order (``dropDuplicates`` would take any)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def duplicate_audit(df: DataFrame, key: str) -> DataFrame:
    """Distinct keys, duplicated keys, rows under those, and the highest multiplicity."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    many = F.col("n") > 1
    return n.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(many).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("rows_in_duplicates"),
        F.max("n").alias("max_multiplicity"),
    )


def reason_flags(**reasons: Column) -> Column:
    """The names of the conditions that hold, joined by semicolons, in the order given."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()])), ";")


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(*steps[0])
    for condition, name in steps[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)


def id_set_hash(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 of the sorted distinct ids, one a line, of each group. The digest needs a group's list of ids in one place."""
    ids = F.array_sort(F.collect_set(F.col(key).cast("string")))
    return df.groupBy(*by).agg(F.upper(F.sha2(F.array_join(ids, "\n"), 256)).alias("id_hash"), F.count_distinct(key).alias("id_count"))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct members; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def representative_strict(poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``representative``, but with the rank of the best pose, and a group without a good pose is an error."""
    ok = (F.col("status") == "ok") & F.col("docking_score").isNotNull()
    order = F.struct("docking_score", "pose_rank")
    first, best = F.min(F.when(ok & (F.col("pose_rank") == 1), F.col("docking_score"))), F.min(F.when(ok, order))
    out = poses.groupBy(*keys).agg(first.alias("first"), best.alias("best"), F.count_if(ok).alias("pose_count"))
    failed = F.raise_error(F.lit("a pair without a successful pose")).cast("double")
    score = F.when(F.col("pose_count") == 0, failed).otherwise(F.coalesce("first", "best.docking_score"))
    return out.select(
        *keys, score.alias("representative_score"), F.col("best.pose_rank").alias("best_pose_rank"), F.col("best.docking_score").alias("best_docking_score"), "pose_count"
    )


def pivot_strict(long: DataFrame, keys: Sequence[str], column: str, values: Sequence, score: str) -> DataFrame:
    """Long to wide where every cell must be there; the task fails otherwise."""
    out = pivot_scores(long, keys, column, values, score)
    failed = F.raise_error(F.lit("missing cell")).cast("double")
    return out.select(*keys, *[F.coalesce(F.col(f"`{x}`"), failed).alias(str(x)) for x in values])


def matched_residues(first: DataFrame, second: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Every row of either side by key with both names and its ``state``: matched, name_differs, only_first or only_second."""
    keys = list(keys)
    a = first.select(*keys, F.col(name).alias(f"{name}_a"), F.lit(True).alias("__a"))
    both = a.join(second.select(*keys, F.col(name).alias(f"{name}_b"), F.lit(True).alias("__b")), keys, "full")
    state = F.when(F.col("__b").isNull(), "only_first").when(F.col("__a").isNull(), "only_second")
    state = state.when(F.col(f"{name}_a").eqNullSafe(F.col(f"{name}_b")), "matched").otherwise("name_differs")
    return both.select(*keys, f"{name}_a", f"{name}_b", state.alias("state"))

"""Rank metrics over any key columns.

Lower scores are better, and ties go to the smaller id. All metrics of a key come from one
sort of its rows, in pieces that many tasks share, in one grouped query: replicates, folds,
subsets or bootstrap draws are just further key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators.order import score_piece, spread

NAN = float("nan")


def ranked(df: DataFrame, keys: Sequence[str], score: str = "score", id_: str = "ligand_id", n: str | None = None) -> DataFrame:
    """``df`` with ``rank``, 1 for the best, by score and then id, and the key's rows as ``n`` if named."""
    out = spread(df, keys, score_piece(score), [score, id_])
    more = [F.col("__all_n").alias(n)] if n else []
    return out.select(*df.columns, F.col("__to_n").alias("rank"), *more)


def best(df: DataFrame, keys: Sequence[str], k: int, score: str = "score", id_: str = "ligand_id") -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``; partitions send on ``k`` rows per key at most."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(score, id_)))
    return out.filter(F.col("rank") <= k)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "average_rank") -> DataFrame:
    """``df`` with ranks from 1 at the smallest value; equal values share their mean rank."""
    return spread(df, keys, score_piece(value), [value], ties=value).select(*df.columns, F.col("__mean").alias(name))


def top_count(n: Column, fraction: float) -> Column:
    """How many rows the top fraction holds: rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(float(fraction))).cast("long"))


def metrics(
    df: DataFrame,
    keys: Sequence[str],
    score: str = "score",
    id_: str = "ligand_id",
    label: str = "label",
    active: str = "active",
    alpha: float = 20.0,
    fractions: Sequence[float] = (0.01, 0.05, 0.10),
    top: int = 10,
) -> DataFrame:
    """Per key: counts, ROC-AUC, average precision, BEDROC, enrichment factors and the top ids.

    Undefined metrics are NaN: the AUC without both labels, precision and enrichment
    without actives, BEDROC without both labels.
    """
    keys = list(keys)
    is_active = F.when(F.col(label) == active, 1).otherwise(0)
    rows = df.select(*keys, score, id_, is_active.alias("__a"))
    rows = spread(rows, keys, score_piece(score), [score, id_], {"a": F.col("__a")}, ties=score).select(
        "__k",
        id_,
        "__a",
        F.col("__to_n").alias("__r"),
        F.col("__to_a").alias("__seen"),
        (F.col("__all_n") + 1 - F.col("__mean")).alias("__ar"),  # from 1 at the largest score
        F.col("__all_n").alias("__n"),
        F.col("__all_a").alias("__m"),
    )
    on, r, n, m = F.col("__a") == 1, F.col("__r"), F.col("__n"), F.col("__m")
    decay = F.exp(F.lit(-float(alpha)) * r / n)
    hits = {f: F.sum(F.when(r <= top_count(n, f), F.col("__a"))).alias(f"__h{i}") for i, f in enumerate(fractions)}
    agg = rows.groupBy("__k").agg(
        F.max("__n").alias("n"),
        F.max("__m").alias("m"),
        F.sum(F.when(on, F.col("__ar"))).alias("ranks"),
        F.sum(F.when(on, F.col("__seen") / r)).alias("precisions"),
        F.sum(F.when(on, decay)).alias("seen"),
        F.sum(F.when(r <= m, decay)).alias("most"),
        F.sum(F.when(r > n - m, decay)).alias("least"),
        *hits.values(),
        F.sum(F.when(r <= top, F.col("__a"))).alias("top_hits"),
        F.array_sort(F.collect_list(F.when(r <= top, F.struct(r.alias("r"), F.col(id_).alias("i"))))).alias("tops"),
    )
    n, m = F.col("n"), F.col("m")
    both = (m > 0) & (m < n)
    out = [
        *[F.col("__k")[k].alias(k) for k in keys],
        n.alias("ligand_count"),
        m.alias("active_count"),
        F.when(both, (F.col("ranks") - m * (m + 1) / 2) / (m * (n - m))).otherwise(NAN).alias("roc_auc"),
        F.when(m > 0, F.col("precisions") / m).otherwise(NAN).alias("average_precision"),
        F.when(both & (F.col("most") != F.col("least")), (F.col("seen") - F.col("least")) / (F.col("most") - F.col("least")))
        .otherwise(NAN)
        .alias("bedroc"),
    ]
    for i, f in enumerate(fractions):
        ef = F.when(m > 0, (F.col(f"__h{i}") / top_count(n, f)) / (m / n)).otherwise(NAN)
        out.append(ef.alias(f"ef{round(100 * f)}"))
    ids = F.transform("tops", lambda x: x["i"].cast("string"))
    return agg.select(*out, F.col("top_hits").alias("top10_active_count"), F.array_join(ids, ";").alias("top10_ids"))


def pearson(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation per key. Where a side is constant: 1 if the two are identical, else 0."""
    group = Window.partitionBy(*keys)
    d = df.select(
        *keys,
        (F.col(a) - F.avg(a).over(group)).alias("__x"),
        (F.col(b) - F.avg(b).over(group)).alias("__y"),
        F.max(F.abs(F.col(a) - F.col(b))).over(group).alias("__far"),
        (F.max(a).over(group) - F.min(a).over(group)).alias("__ra"),
        (F.max(b).over(group) - F.min(b).over(group)).alias("__rb"),
    )
    agg = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.sum(F.col("__x") * F.col("__y")).alias("xy"),
        F.sum(F.col("__x") * F.col("__x")).alias("xx"),
        F.sum(F.col("__y") * F.col("__y")).alias("yy"),
        F.max("__far").alias("far"),
        F.least(F.max("__ra"), F.max("__rb")).alias("flat"),
    )
    r = F.when(F.col("flat") == 0, F.when(F.col("far") == 0, 1.0).otherwise(0.0)).otherwise(
        F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
    )
    return agg.select(*keys, "pair_count", r.alias("r"))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation of average ranks."""
    ranks = average_rank(average_rank(df.select(*keys, a, b), keys, a, "__ra"), keys, b, "__rb")
    return pearson(ranks, keys, "__ra", "__rb")


def top_overlap(df: DataFrame, keys: Sequence[str], a: str, b: str, k: int, id_: str = "ligand_id") -> DataFrame:
    """How many ids two orderings share among their first ``k``."""
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("top_n"))
    both = best(df.select(*keys, id_, a), keys, k, a, id_).select(*keys, id_).join(best(df.select(*keys, id_, b), keys, k, b, id_).select(*keys, id_), [*keys, id_])
    shared = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("__s"))
    out = counts.join(shared, keys, "left").select(*keys, F.coalesce("__s", F.lit(0)).alias("shared"), "top_n")
    return out.withColumn("overlap", F.col("shared") / F.col("top_n"))

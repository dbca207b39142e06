"""Splits and folds that keep groups together.

Orders come from SHA-256 of seed and id, so a split does not depend on how rows arrive.
Assignments that look at what was assigned before run on the driver, over the table of
groups (one row each, with counts per label), never over the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators.order import hash_piece, spread

GROUPS_ON_DRIVER = 200_000


def hash_order(seed: int, c: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|"), (F.col(c) if isinstance(c, str) else c).cast("string")), 256)


def hash_ranked(df: DataFrame, keys: Sequence[str], key: Column, id_: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``spread`` of ``df`` in the order of the hexadecimal hash ``key`` and then the id."""
    rows = df.withColumn("__h", key)
    return spread(rows, keys, hash_piece(F.col("__h")), ["__h", id_], sums)


def _shares(at: Column, n: Column, train: float, validation: float) -> Column:
    first, second = F.floor(n * train), F.floor(n * (train + validation))
    return F.when(at <= first, "train").when(at <= second, "validation").otherwise("test")


def stratified_split(df: DataFrame, id_: str, label: str, seed: int, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """``df`` with ``split``: within each label the first shares of a hash order."""
    out = hash_ranked(df, [label], hash_order(seed, id_), id_)
    return out.select(*df.columns, _shares(F.col("__to_n"), F.col("__all_n"), train, validation).alias("split"))


def label_folds(df: DataFrame, id_: str, label: str, folds: int, seed: int) -> DataFrame:
    """``df`` with ``fold``: dealt in turn within each label, in a hash order."""
    out = hash_ranked(df, [label], hash_order(seed, id_), id_)
    return out.select(*df.columns, ((F.col("__to_n") - 1) % folds).cast("int").alias("fold"))


def rotations(df: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Each row once per rotation: the rotation's fold is tested, the next validated, the rest trained on."""
    every = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    out = df.withColumn("rotation", every)
    role = F.when(F.col(fold) == F.col("rotation"), "test").when(F.col(fold) == (F.col("rotation") + 1) % folds, "validation")
    return out.withColumn("role", role.otherwise("train"))


def nested_roles(df: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Each row once per outer fold ``o``, with its own fold as ``i``: the outer test where they are equal, else an inner validation."""
    return df.withColumns({"o": F.explode(F.sequence(F.lit(0), F.lit(folds - 1))), "i": F.col(fold)})


def nested_bounds(df: DataFrame, folds: int, keys: Sequence[str], score: str = "score", fold: str = "fold") -> DataFrame:
    """``o, i, *keys, lower, upper`` over the rows of all folds but ``o`` and ``i``, from one row per fold and key."""
    per = df.groupBy(fold, *keys).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    every = F.sequence(F.lit(0), F.lit(folds - 1))
    per = per.withColumn("o", F.explode(every)).withColumn("i", F.explode(every))
    per = per.filter((F.col(fold) != F.col("o")) & (F.col(fold) != F.col("i")))
    return per.groupBy("o", "i", *keys).agg(F.min("__lo").alias("lower"), F.max("__hi").alias("upper"))


def connected_groups(df: DataFrame, id_: str, links: Sequence[str], checkpoint=None) -> DataFrame:
    """``id, group``: rows that share a value in any of ``links``, directly or through others; the smallest id names a group.

    Values that meet in a row pass the smallest id to each other until nothing changes; rows
    take part only before and after, so a round costs as much as there are values. ``checkpoint``
    cuts the plan between rounds (by default Spark's reliable checkpoint where a folder is set).
    """
    cut = checkpoint or checkpointed
    value = lambda c: F.when(F.col(c).isNotNull() & F.col(id_).isNotNull(), F.concat_ws(":", F.lit(c), F.col(c).cast("string")))
    rows = df.select(id_, F.array_compact(F.array(*[value(c) for c in links])).alias("__vs"))
    rows = rows.groupBy(id_).agg(F.array_distinct(F.flatten(F.collect_list("__vs"))).alias("__vs"))
    rows = cut(rows.withColumn("__hub", F.array_min("__vs")))
    met = rows.select(id_, "__hub", F.explode("__vs").alias("__v"))
    labels = cut(met.groupBy("__v").agg(F.min(id_).alias("group")))
    pairs = met.select(F.col("__v").alias("__a"), F.col("__hub").alias("__b")).filter("__a <> __b").distinct()
    pairs = cut(pairs.union(pairs.select("__b", "__a")))
    while True:
        seen = pairs.join(labels, F.col("__b") == F.col("__v")).groupBy("__a").agg(F.min("group").alias("__g"))
        fresh = labels.join(seen, F.col("__v") == F.col("__a"), "left").select("__v", F.col("group").alias("__old"), F.least("group", "__g").alias("group"))
        fresh = cut(fresh)
        labels = fresh.select("__v", "group")
        if fresh.filter("group <> __old").isEmpty():
            break
    out = rows.join(labels, F.col("__hub") == F.col("__v"), "left")
    return out.select(id_, F.coalesce("group", id_).alias("group"))


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's shared folder; only a session on one machine may lack that setting."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        import re
        import tempfile

        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="orrery-checkpoint-"))
    return df.checkpoint()


def released(spark) -> None:
    """Lets go of shuffles and checkpoints that nothing refers to any more; Spark removes them once their handles are collected."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def group_table(df: DataFrame, group: str, label: str, labels: Sequence[str]) -> list[tuple]:
    """(group, counts per label), the largest first, on the driver."""
    counts = [F.count_if(F.col(label) == x).alias(f"__{i}") for i, x in enumerate(labels)]
    table = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *counts)
    rows = table.limit(GROUPS_ON_DRIVER + 1).collect()
    if len(rows) > GROUPS_ON_DRIVER:
        raise ValueError(f"more than {GROUPS_ON_DRIVER} groups; sequential assignment is not meant for them")
    return sorted(((r[group], tuple(r[f"__{i}"] for i in range(len(labels)))) for r in rows), key=lambda x: (-sum(x[1]), str(x[0])))


def balanced_folds(groups: Sequence[tuple], folds: int) -> dict:
    """A fold per group: each goes where labels, and then sizes, end up closest to even shares."""
    if not groups:
        return {}
    width = len(groups[0][1])
    totals = [sum(c[i] for _, c in groups) for i in range(width)]
    goals = [t / folds for t in totals]
    goal = sum(totals) / folds
    state = [[0] * width for _ in range(folds)]
    placed = {}
    # Only the receiving fold's term changes, so costs compare by that term alone.
    off = lambda have, want: ((have - want) / max(1.0, want)) ** 2
    for name, counts in groups:

        def rise(f: int, counts=counts) -> tuple:
            now, then = state[f], [a + b for a, b in zip(state[f], counts, strict=True)]
            by_label = sum(off(b, g) - off(a, g) for a, b, g in zip(now, then, goals, strict=True))
            return round(by_label, 12), round(off(sum(then), goal) - off(sum(now), goal), 12), f

        best = min(range(folds), key=rise)
        placed[name] = best
        state[best] = [a + b for a, b in zip(state[best], counts, strict=True)]
    return placed


def assign(df: DataFrame, group: str, placed: dict, name: str = "fold") -> DataFrame:
    """``df`` with the fold of each row's group."""
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame(list(placed.items()), f"{group} {kind}, {name} int")
    return df.join(table, group)


def hash_ordered_panel(df: DataFrame, group: str, label: str, seed: int, ratio: float) -> DataFrame:
    """All groups that hold an active, then whole groups of decoys in a hash order until they reach ``ratio`` decoys per active."""
    per = df.groupBy(group).agg(F.count_if(F.col(label) == "active").alias("actives"), F.count_if(F.col(label) == "decoy").alias("decoys"))
    with_active = per.filter("actives > 0")
    totals = with_active.agg(F.sum("actives").alias("a"), F.sum("decoys").alias("d"))
    rest = hash_ranked(per.filter("actives = 0"), [], hash_order(seed, group), group, {"d": F.col("decoys")})
    rest = rest.select(group, (F.col("__to_d") - F.col("decoys")).alias("before"))
    filled = rest.crossJoin(totals).filter(F.col("d") + F.col("before") < ratio * F.col("a"))
    return df.join(with_active.select(group).union(filled.select(group)), group, "left_semi")


def greedy_splits(groups: Sequence[tuple], shares: dict[str, float]) -> dict:
    """Whole groups to splits, the largest first: where they overshoot the targets least, then where they end nearest to them, then by name."""
    totals = [sum(counts) for counts in zip(*(c for _, c in groups), strict=True)]
    targets = {s: [share * t for t in totals] for s, share in shares.items()}
    filled = {s: [0] * len(totals) for s in shares}
    placed = {}
    for group, counts in groups:

        def cost(split: str, counts=counts) -> tuple[float, float, str]:
            off = [(have + more - want) / max(1.0, want) for have, more, want in zip(filled[split], counts, targets[split], strict=True)]
            return sum(max(0.0, x) for x in off), sum(map(abs, off)), split

        placed[group] = split = min(shares, key=cost)
        filled[split] = [a + b for a, b in zip(filled[split], counts, strict=True)]
    return placed


def random_sample(df: DataFrame, id_: str, label: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of each label in a hash order."""
    at = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(seed, id_), id_))
    return df.withColumn("__at", at).filter(F.col("__at") <= n).drop("__at")


def diverse_sample(df: DataFrame, id_: str, label: str, group: str, labels: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of each label in a hash order, no two of them from one group; earlier labels choose first."""
    order = [hash_order(seed, id_), F.col(id_)]
    firsts = df.withColumn("__g", F.row_number().over(Window.partitionBy(label, group).orderBy(*order))).filter("__g = 1").drop("__g")
    out = None
    for name in labels:
        left = firsts.filter(F.col(label) == name)
        if out is not None:
            left = left.join(out.select(group), group, "left_anti").select(*df.columns)
        chosen = left.orderBy(*order).limit(n)
        out = chosen if out is None else out.unionByName(chosen)
    return out


def repeated_splits(df: DataFrame, id_: str, label: str, repeats: int, seed: int) -> DataFrame:
    """A stratified split per ``repeat``, each in its own hash order."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    key = F.sha2(F.concat((F.col("repeat") + seed).cast("string"), F.lit("|"), F.col(id_).cast("string")), 256)
    out = hash_ranked(rows, ["repeat", label], key, id_)
    return out.select(*rows.columns, _shares(F.col("__to_n"), F.col("__all_n"), 0.6, 0.2).alias("split"))

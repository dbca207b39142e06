"""Quadratic objectives fitted in many training contexts at once.

A context is a training set that leaves out two folds, one, or none: ``(a, b)`` with a before
b, ``(a, a)`` or ``(-1, -1)``. Rows of a left-out fold validate there (``part`` is that fold),
all others train (``part`` is -1). So all inner and outer contexts of a nested cross-validation
are key columns of the same few grouped queries, and a training set that two outer folds
share is looked at once. Scaling bounds, metrics and terms of a context come from its
training rows alone.

Every candidate of a family is a row of weights; its energy over a subset is a weighted sum of
the subset's term sums, so all candidates, contexts and subsets meet in one join of small
tables (contexts times subsets times candidates; never rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators import ranking

FULL = -1
CONTEXT = ["a", "b"]
#: Weights of a candidate, with the sign by which each enters the energy and the term that it weighs.
UNARY = {"w_coverage": (-1, "coverage"), "w_exposure": (1, "exposure"), "w_stability": (-1, "stability")}
PAIR = {"w_overlap": (1, "overlap"), "w_redundancy": (1, "redundancy")}
#: Pair terms of the candidate's own aggregation.
BY_HOW = {"w_utility": (-1, "pair_utility"), "w_synergy": (-1, "pair_synergy")}
WEIGHTS = [*UNARY, *PAIR, *BY_HOW]


def pick(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The first row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def contexts(folds: int) -> list[tuple[int, int]]:
    return [(FULL, FULL), *[(a, b) for a in range(folds) for b in range(a, folds)]]


def context_bounds(scores: DataFrame, folds: int, keys: Sequence[str] = ()) -> DataFrame:
    """``*keys, a, b, receptor_id, lower, upper`` of the training rows of each context."""
    every = F.broadcast(scores.sparkSession.createDataFrame(contexts(folds), "a int, b int"))
    per = scores.groupBy(*keys, "receptor_id", "fold").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return per.join(every, _inside()).groupBy(*keys, "a", "b", "receptor_id").agg(F.min("lo").alias("lower"), F.max("hi").alias("upper"))


def _inside() -> Column:
    return (F.col("fold") != F.col("a")) & (F.col("fold") != F.col("b"))


def _scaled(score: Column | str, lower: Column | str, width: Column) -> Column:
    # Whole billionths: sums over a subset stay exact, so equal ensembles tie however they are added up.
    score, lower = (F.col(c) if isinstance(c, str) else c for c in (score, lower))
    return F.when(width == 0, 0).otherwise(F.round((score - lower) / width * 1e9).cast("long"))


def context_rows(scores: DataFrame, folds: int, keys: Sequence[str] = (), bounds: DataFrame | None = None) -> DataFrame:
    """``*keys, a, b, part, receptor_id, ligand_id, label, score`` of rows with a ``fold``, scaled by the context's training rows to billionths."""
    bounds = context_bounds(scores, folds, keys) if bounds is None else bounds
    scaled = _scaled("score", "lower", F.col("upper") - F.col("lower"))
    rows = scores.join(F.broadcast(bounds), [*keys, "receptor_id"])  # a row for each scorer and context
    part = F.when(_inside(), FULL).otherwise(F.col("fold")).alias("part")
    return rows.select(*keys, "a", "b", part, "receptor_id", "ligand_id", "label", scaled.alias("score"))


def context_wide(scores: DataFrame, bounds: DataFrame, members: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """The rows of ``context_rows`` as ``ranksums.wide_scores``: a ligand is shuffled and stored once, its contexts are made where it is read."""
    from orrery.operators.folds import checkpointed
    from orrery.operators.ranksums import wide_scores

    known = scores.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(float("nan"))))  # a null score is a row, too
    base = checkpointed(wide_scores(known, members, [*keys, "fold"]))
    of = lambda c, m: F.max(F.when(F.col("receptor_id") == m, F.col(c)))
    limits = bounds.groupBy(*keys, "a", "b").agg(*[of(c, m).alias(f"__{c}{i}") for i, m in enumerate(members) for c in ("lower", "upper")])
    each = base.join(F.broadcast(limits), list(keys)) if keys else base.join(F.broadcast(limits))  # a row for each context
    out = []
    for i in range(len(members)):
        x, width = F.col(f"__x{i}"), F.col(f"__upper{i}") - F.col(f"__lower{i}")
        held = F.when(x.isNull() | (F.isnan(x) & ~F.coalesce(width == 0, F.lit(False))), F.lit(None).cast("long"))
        out.append(held.otherwise(_scaled(x, f"__lower{i}", width)).cast("double").alias(f"__x{i}"))
    return each.select("__id", *keys, "a", "b", F.when(_inside(), FULL).otherwise(F.col("fold")).alias("part"), "__active", *out)


def ensemble_scores(rows: DataFrame, subsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, how, mask, ligand_id, label, score``: least and mean score of each subset; one row for a single member.

    A ligand's scores are brought together once; its subsets are then made where it is, so no row of a subset is shuffled.
    """
    by = [*keys, "ligand_id", "label"]
    held = rows.groupBy(*by).agg(F.collect_list(F.struct("receptor_id", "score")).alias("__held"))
    each = held.join(F.broadcast(subsets.select("mask", "subset")))
    mine = F.filter("__held", lambda x: F.array_contains("subset", x["receptor_id"]))
    each = each.withColumn("__mine", F.transform(mine, lambda x: x["score"])).filter(F.size("__mine") > 0)
    known = F.array_compact("__mine")
    total = F.aggregate(known, F.lit(0.0), lambda t, x: t + x)
    both = each.select(*by, "mask", F.array_min(known).alias("min"), F.when(F.size(known) > 0, F.round(total / F.size(known), 9)).alias("mean"))
    return both.unpivot([*by, "mask"], ["min", "mean"], "how", "score").filter((F.col("how") == "min") | (F.bit_count("mask") > 1))


#: Folds of a context that a packed key can tell apart.
PACKED_FOLDS = 63


def ensemble_metrics(scored: DataFrame, keys: Sequence[str], top: int = 10) -> DataFrame:
    """``ranking.metrics`` of ``ensemble_scores``, whose rows carry context, ``how`` and ``mask`` as one number, not as five columns and a string."""
    kinds, inside = dict(scored.dtypes), [k for k in keys if k in ("a", "b", "part")]
    number = F.col("mask").cast("long") * 2 + F.when(F.col("how") == "mean", 1).otherwise(0)
    for k in inside:
        fits = (F.col(k) >= FULL) & (F.col(k) + 1 <= PACKED_FOLDS)
        number = number * (PACKED_FOLDS + 1) + F.when(fits, F.col(k) + 1).otherwise(F.raise_error(F.lit(f"{k} is not a fold")).cast("int"))
    others = [k for k in keys if k not in ("how", "mask", *inside)]
    found = ranking.metrics(scored.select(number.alias("__key"), *others, "ligand_id", "label", "score"), ["__key", *others], top=top)
    rest, back = F.col("__key"), {}
    for k in reversed(inside):
        back[k] = (rest % (PACKED_FOLDS + 1) - 1).cast(kinds[k])
        rest = F.floor(rest / (PACKED_FOLDS + 1))
    back |= {"how": F.when(rest % 2 == 1, "mean").otherwise("min"), "mask": F.floor(rest / 2).cast(kinds["mask"])}
    measured = [c for c in found.columns if c not in ("__key", *others)]
    return found.select(*[back[k].alias(k) if k in back else k for k in keys], *measured)


def scaled_by(df: DataFrame, keys: Sequence[str], names: Sequence[str], signed: Sequence[str] = ()) -> DataFrame:
    """Terms between 0 and 1 within the key (0 where all are alike), those named ``signed`` over their largest size."""
    w = Window.partitionBy(*keys)
    out = {}
    for c in names:
        low, high = F.min(c).over(w), F.max(c).over(w)
        out[c] = F.when(high == low, 0.0).otherwise((F.col(c) - low) / (high - low))
    for c in signed:
        most = F.max(F.abs(c)).over(w)
        out[c] = F.when(most == 0, 0.0).otherwise(F.col(c) / most)
    return df.withColumns(out)


def rank_correlations(train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``*keys, x, y, redundancy``: rank correlation of two scorers over the ligands of both, zero where it is negative.

    A ligand's ranks meet once and its pairs are made there, so no row of a pair is shuffled;
    only sums are. Where a side is constant: 1 if the two are identical, else 0.
    """
    keys = list(keys)
    placed = ranking.average_rank(train.select(*keys, "receptor_id", "ligand_id", "score"), [*keys, "receptor_id"], "score")
    held = placed.filter(F.col("ligand_id").isNotNull()).groupBy(*keys, "ligand_id").agg(F.collect_list(F.struct(F.col("receptor_id").cast("int").alias("m"), F.col("average_rank").alias("r"))).alias("__held"))
    pairs = F.explode(F.flatten(F.transform("__held", lambda a: F.transform(F.filter("__held", lambda b: a["m"] < b["m"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("__p")
    both = held.select(*keys, pairs).select(*keys, F.col("__p.a.m").alias("x"), F.col("__p.b.m").alias("y"), F.col("__p.a.r").alias("rx"), F.col("__p.b.r").alias("ry"))
    found = both.groupBy(*keys, "x", "y").agg(
        F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("r"), F.max(F.abs(F.col("rx") - F.col("ry"))).alias("far"), ((F.max("rx") == F.min("rx")) | (F.max("ry") == F.min("ry"))).alias("flat")
    )
    r = F.when(F.col("flat"), F.when(F.col("far") == 0, 1.0).otherwise(0.0)).otherwise(F.col("r"))
    return found.select(*keys, "x", "y", F.greatest(F.lit(0.0), F.round(r, 6)).alias("redundancy"))


def raw_terms(train: DataFrame, measured: DataFrame, keys: Sequence[str], utility: str, fraction: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Terms of single scorers (``member``) and of pairs (``x, y``) per context, unscaled.

    ``measured`` holds the training metrics by ``how, mask``. Coverage and exposure are the
    shares of actives and decoys in the top fraction, overlap the share of actives that both
    have there, redundancy the rank correlation without its sign below zero. The synergy of a
    pair is what its ensemble adds to the better of the two.
    """
    keys = list(keys)
    place = lambda mask: F.log2(mask).cast("int")
    single = measured.filter(F.bit_count("mask") == 1).select(
        *keys, place(F.col("mask")).alias("member"), F.col(utility).alias("utility"), "bedroc", "active_count", "ligand_count"
    )
    ranks = ranking.ranked(train, [*keys, "receptor_id"], n="n").filter(F.col("rank") <= ranking.top_count(F.col("n"), fraction))
    active = F.col("label") == "active"
    top = ranks.groupBy(*keys, F.col("receptor_id").cast("int").alias("member")).agg(F.count_if(active).alias("hits"), F.count_if(~active).alias("misses"))
    unary = single.join(top, [*keys, "member"]).select(
        *keys,
        "member",
        "utility",
        F.round(F.col("hits") / F.col("active_count"), 6).alias("coverage"),
        F.round(F.col("misses") / (F.col("ligand_count") - F.col("active_count")), 6).alias("exposure"),
    )

    of = lambda df, name, *more: df.select(*keys, "ligand_id", F.col("receptor_id").cast("int").alias(name), *more)
    tops = ranks.filter(active)
    shared = of(tops, "x").join(of(tops, "y"), [*keys, "ligand_id"]).filter("x < y").groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("shared"))
    rho = rank_correlations(train, keys)

    bits = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c))
    pairs = measured.filter(F.bit_count("mask") == 2).groupBy(*keys, "mask").agg(
        *[F.max(F.when(F.col("how") == h, F.col("bedroc"))).alias(f"pair_utility_{h}") for h in ("min", "mean")], F.max("active_count").alias("actives")
    )
    side = lambda name, b: single.select(*keys, F.col("member").alias(name), F.col("bedroc").alias(b))
    out = rho.withColumn("mask", bits("x") + bits("y")).join(pairs, [*keys, "mask"]).join(shared, [*keys, "x", "y"], "left")
    out = out.join(side("x", "bx"), [*keys, "x"]).join(side("y", "by"), [*keys, "y"])
    better = F.greatest("bx", "by")
    return unary, out.select(
        *keys,
        "x",
        "y",
        "redundancy",
        F.round(F.coalesce("shared", F.lit(0)) / F.col("actives"), 6).alias("overlap"),
        *[f"pair_utility_{h}" for h in ("min", "mean")],
        *[F.round(F.col(f"pair_utility_{h}") - better, 6).alias(f"pair_synergy_{h}") for h in ("min", "mean")],
    )


def term_sums(unary: DataFrame, pairs: DataFrame, subsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per context and subset, the sum of each term over its members and over its pairs."""
    keys = list(keys)
    bit = lambda c: F.getbit("mask", F.col(c)) == 1
    masks = F.broadcast(subsets.select("mask", "size"))
    one = [c for c in unary.columns if c not in (*keys, "member")]
    two = [c for c in pairs.columns if c not in (*keys, "x", "y")]
    own = unary.join(masks, bit("member")).groupBy(*keys, "mask", "size").agg(*[F.sum(c).alias(c) for c in one])
    both = pairs.join(masks, bit("x") & bit("y")).groupBy(*keys, "mask").agg(*[F.sum(c).alias(c) for c in two])
    out = own.join(both, [*keys, "mask"], "left")
    return out.select(*keys, "mask", "size", *one, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in two])


def energy(penalty: float) -> Column:
    """The energy of a subset (its term sums) under a candidate (its weights, ``target`` and ``how``)."""
    total = -F.col("utility") + F.lit(float(penalty)) * (F.col("size") - F.col("target")) * (F.col("size") - F.col("target"))
    for w, (sign, term) in {**UNARY, **PAIR}.items():
        total = total + F.lit(float(sign)) * F.col(w) * F.col(term)
    for w, (sign, term) in BY_HOW.items():
        total = total + F.lit(float(sign)) * F.col(w) * F.when(F.col("how") == "min", F.col(f"{term}_min")).otherwise(F.col(f"{term}_mean"))
    return total


def candidate_grid(family: str, sizes: Sequence[int], hows: Sequence[str], **values: Sequence[float]) -> list[tuple]:
    """``family, target, how`` and the weights of every combination; weights that are not named are 0."""
    names = [w for w in WEIGHTS if w in values]
    if set(values) - set(WEIGHTS):
        raise ValueError(f"unknown weights: {sorted(set(values) - set(WEIGHTS))}")
    out = []
    for size, how, *chosen in product(sizes, hows, *[values[w] for w in names]):
        at = dict(zip(names, chosen, strict=True))
        out.append((family, size, how, *[float(at.get(w, 0.0)) for w in WEIGHTS]))
    return out


def candidate_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Candidates with their number ``cid``; earlier ones win ties."""
    schema = f"cid int, family string, target int, how string, {', '.join(f'{w} double' for w in WEIGHTS)}"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def solved(sums: DataFrame, candidates: DataFrame, keys: Sequence[str], penalty: float) -> DataFrame:
    """The subset of least energy per context and candidate; ties go to the subset that comes first member by member.

    Where ``sums`` has ``required``, a mask of members that must be in (null: none), only
    subsets of the candidate's own size that hold them count.
    """
    scored = sums.join(F.broadcast(candidates)).withColumn("energy", F.round(energy(penalty), 9))  # candidates: a row for each setting
    if "required" in sums.columns:
        held = (F.col("mask").bitwiseAND(F.col("required")) == F.col("required")) & (F.col("size") == F.col("target"))
        scored = scored.filter(F.col("required").isNull() | held)
    return pick(scored, [*keys, "cid"], "energy", in_order("mask"))


def in_order(mask: str) -> Column:
    """Orders masks as tuples of their members compare: by the first member, then the next; a prefix comes first."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(F.col(mask), i) == 1)

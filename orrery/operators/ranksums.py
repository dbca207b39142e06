"""Rank metrics of all subsets of a few scorers, without a row for each subset.

A ligand's scores stand in one row. Ranges of ligands are sorted subset by subset in numpy, and
what leaves a task is a run: the steps between the sorted scores and a bit for each label. Ids
are not sent, as runs of a key come in the order of their ranges, so ties keep the order of
ids. Runs of a key are cut at fixed scores into pieces; each piece is put together in a task
of its own, with the rows and actives before it added from a table of one row per piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import lcm

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators.ranking import NAN, top_count

#: Rows that a task sorts at a time; rows of a piece, about.
CHUNK, PIECE_ROWS = 1 << 20, 1 << 19
#: Bytes of runs that are stored at a time, about, and of a row in a run; beyond that, subsets take turns.
STORED, RUN_BYTES = 1 << 32, 3
RUNS = "__k int, __key long, __piece int, __tag long, __n long, __m long, __low long, __run binary"
SUMS = "__k int, __key long, n long, m long, ranks double, precisions double, seen double"


def billionths(score: Column | str) -> Column:
    """Scores of at most nine places as whole numbers."""
    return F.round(F.round(score, 9) * 1e9).cast("long")


def pack(scores: np.ndarray, active: np.ndarray) -> tuple[int, bytes]:
    """The first of sorted whole scores, and the steps between them beside the labels."""
    steps = np.diff(scores)
    kind = np.uint64 if len(steps) and int(steps.max()) >> 32 else np.uint32 if len(steps) and int(steps.max()) >> 16 else np.uint16
    return int(scores[0]), bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes() + np.packbits(active).tobytes()


def unpack(low: int, run: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    width = run[0]
    steps = np.frombuffer(run, f"u{width}", n - 1, 1)
    scores = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)]) + low
    return scores, np.unpackbits(np.frombuffer(run, np.uint8, offset=1 + width * (n - 1)), count=n).astype(bool)


def in_order(scores: np.ndarray) -> np.ndarray:
    """Places by score, equal ones as they stand."""
    low, bits = int(scores.min()), len(scores).bit_length()
    if (int(scores.max()) - low).bit_length() + bits > 62:
        return np.argsort(scores, kind="stable")
    return np.sort(((scores - low) << bits) | np.arange(len(scores))) & ((1 << bits) - 1)


def _runs(masks: list[int], members: int, whole: bool, pieces: int, low: float, high: float):
    """Runs of batches (``__k``, id, active, scores of the members) in the order of ids."""
    chosen = [(mask, [i for i in range(members) if mask >> i & 1]) for mask in masks]
    edges = low + (high - low) * np.arange(1, pieces) / pieces

    def cut(k, ids, active, x):
        order = np.argsort(k, kind="stable")
        k, active, x = k[order], active[order], x[:, order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])).tolist()
        out = []
        for a, b in zip(starts, [*starts[1:], len(k)], strict=True):
            part, is_active = x[:, a:b], active[a:b]
            gaps = bool(np.isnan(part).any())
            for mask, at in chosen:
                mine, labels = part[at], is_active
                count = len(at) - np.isnan(mine).sum(axis=0) if gaps else len(at)
                if gaps:
                    have = count > 0
                    mine, labels, count = mine[:, have], is_active[have], count[have]
                    if not len(labels):
                        continue
                unit = 1 if whole else lcm(*range(1, len(at) + 1))
                made = [(0, 1, np.nanmin(mine, axis=0) if gaps else mine.min(axis=0))]
                if len(at) > 1:
                    total = np.nansum(mine, axis=0) if gaps else mine.sum(axis=0)
                    made.append((1, unit, np.floor(total * unit / count + 0.5)))
                for how, scale, values in made:
                    values = values.astype(np.int64)
                    places = in_order(values)
                    values, mark = values[places], labels[places]
                    ends = [0, *np.searchsorted(values, edges * scale).tolist(), len(values)]
                    for piece, (p, q) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                        if p < q:
                            out.append((int(k[a]), mask * 2 + how, piece, int(ids[0]), q - p, int(mark[p:q].sum()), *pack(values[p:q], mark[p:q])))
        return out

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def sent(held):
            k, ids, active, *x = (np.concatenate(c) for c in zip(*held, strict=True))
            out = cut(k, ids, active, np.stack(x))
            types = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]
            names = [f.split()[0] for f in RUNS.split(", ")]
            for i in range(0, len(out), 10_000):
                columns = zip(*out[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
            now += [batch.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(members)]
            held.append(now)
            rows += batch.num_rows
            if rows >= CHUNK:
                cutoff = int(np.searchsorted(now[1], now[1][-1]))  # an id's rows stay together
                if cutoff:
                    held[-1] = [c[:cutoff] for c in now]
                    yield from sent(held)
                    held = [[c[cutoff:] for c in now]]
                    rows = len(held[0][0])
        if held:
            yield from sent(held)

    return run


def _summed(alpha: float, fractions: Sequence[float], names: list[str], types: list):
    """The sums of a piece from its runs (``__before_n``, ``__before_m``, ``__all_n``: of its key)."""

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by("__tag")
        runs = [unpack(low, b, n) for low, b, n in zip(*(table.column(c).to_pylist() for c in ("__low", "__run", "__n")), strict=True)]
        scores, active = np.concatenate([s for s, _ in runs]), np.concatenate([a for _, a in runs])
        if len(runs) > 1:
            order = np.argsort(scores, kind="stable")
            scores, active = scores[order], active[order]
        before, actives, n = (table.column(c)[0].as_py() for c in ("__before_n", "__before_m", "__all_n"))
        starts = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
        ends = np.append(starts[1:], len(scores))
        at = np.flatnonzero(active)
        group = np.searchsorted(starts, at, side="right") - 1
        mean = before + (starts[group] + ends[group] + 1) / 2
        r = before + at + 1
        values = [len(scores), len(at), float((n + 1 - mean).sum()), float(((actives + np.arange(1, len(at) + 1)) / r).sum()), float(np.exp(-alpha * r / n).sum())]
        values += [int((r <= max(1, int(np.ceil(n * float(f))))).sum()) for f in fractions]
        row = [*(k.as_py() for k in key[:2]), *values]
        return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return run


def wide_scores(rows: DataFrame, members: Sequence, by: Sequence[str]) -> DataFrame:
    """``__id, *by, __active, __x0, ...``: the scores of a ligand in one row, in partitions that hold ranges of ids."""
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # what is made of a row is much more than the row
    coded = rows.select(F.col("ligand_id").cast("long").alias("__id"), *by, (F.col("label") == "active").alias("__active"), "receptor_id", F.col("score").cast("double").alias("__score"))
    scores = [F.max(F.when(F.col("receptor_id") == m, F.col("__score"))).alias(f"__x{i}") for i, m in enumerate(members)]
    return coded.repartitionByRange(tasks, "__id").groupBy("__id", *by).agg(F.coalesce(F.max("__active"), F.lit(False)).alias("__active"), *scores)


def subset_metrics(rows: DataFrame, subsets: DataFrame, members: Sequence, keys: Sequence[str], whole: bool = False, apart: Sequence[str] = (), wide: DataFrame | None = None, alpha: float = 20.0, fractions: Sequence[float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """``*keys, how, mask`` and rank metrics of the least and the mean score of each subset of ``members``.

    ``rows``: keys, ``receptor_id``, ``ligand_id`` (whole numbers), ``label`` and a whole ``score``
    below 2^53 or null; lower ones are better and ties go to the smaller id. They are read
    twice. ``whole`` rounds means to whole numbers, half up. Missing or null members do not
    count; a ligand without any has no row. ``apart`` names what tells apart several rows of one
    ligand, scorer and key. Keys are few (contexts), and their table meets rows by broadcast.
    ``wide``: the same rows as ``wide_scores`` by keys, where they are not to be shuffled; these
    are read once for each turn that the subsets take.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import IntegerType, StructField, StructType

    from orrery.operators.folds import checkpointed, released

    keys, spark = list(keys), rows.sparkSession
    masks = sorted(r["mask"] for r in subsets.select("mask").distinct().collect())  # subsets of a small pool
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), F.min("score").alias("__low"), F.max("score").alias("__high")).collect()  # a row for each context
    kinds = [rows.schema[k] for k in keys]
    table = spark.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(stats)], StructType([*kinds, StructField("__k", IntegerType())]))
    most = max((r["__rows"] for r in stats), default=0) / max(1, len(members))
    ends = [e for r in stats for e in (r["__low"], r["__high"]) if e is not None] or [0]
    pieces = max(1, int(-(-most // PIECE_ROWS)))
    on = [F.col(k).eqNullSafe(F.col(f"__t_{k}")) for k in keys]
    same = on[0] if on else F.lit(True)
    for c in on[1:]:
        same = same & c
    table_ = F.broadcast(table.select(*[F.col(k).alias(f"__t_{k}") for k in keys], "__k"))
    if wide is None:
        coded = rows.join(table_, same)
        coded = coded.select("__k", F.col("ligand_id").cast("long").alias("__id"), (F.col("label") == "active").alias("__active"), "receptor_id", *apart, F.col("score").cast("double").alias("__score"))
        held = coded.repartitionByRange("__id").groupBy("__id", "__k", *apart).agg(F.coalesce(F.max("__active"), F.lit(False)).alias("__active"), *[F.max(F.when(F.col("receptor_id") == m, F.col("__score"))).alias(f"__x{i}") for i, m in enumerate(members)])
    else:
        held = wide.join(table_, same)
    held = held.sortWithinPartitions("__id").select("__k", "__id", "__active", *[f"__x{i}" for i in range(len(members))])
    schema = StructType.fromDDL(", ".join([SUMS, *[f"h{i} long" for i in range(len(fractions))]]))
    along = Window.partitionBy("__k", "__key")
    earlier = along.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)

    def summed(chosen: list[int]) -> DataFrame:
        runs = checkpointed(held.mapInArrow(_runs(chosen, len(members), whole, pieces, float(min(ends)), float(max(ends))), RUNS))
        places = runs.groupBy("__k", "__key", "__piece").agg(F.sum("__n").alias("n"), F.sum("__m").alias("m"))
        places = places.select("__k", "__key", "__piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before_n"), F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("__before_m"), F.sum("n").over(along).alias("__all_n"))
        found = runs.join(places, ["__k", "__key", "__piece"]).groupBy("__k", "__key", "__piece").applyInArrow(_summed(float(alpha), tuple(fractions), schema.names, [to_arrow_type(f.dataType) for f in schema.fields]), schema)
        return found.groupBy("__k", "__key").agg(*[F.sum(c).alias(c) for c in schema.names[2:]])

    size = sum(r["__rows"] for r in stats) / max(1, len(members)) * 2 * len(masks) * RUN_BYTES
    turns = 1 if wide is None else max(1, min(len(masks), int(-(-size // STORED))))
    found = None
    for t in range(turns):
        # Sums of one turn are stored, a row for each context and subset, and its runs let go before the next.
        one = summed(masks[t::turns])
        if turns > 1:
            one = checkpointed(one)
            released(spark)
        found = one if found is None else found.unionByName(one)
    found = found.join(F.broadcast(table), "__k")
    n, m, q = F.col("n"), F.col("m"), F.exp(F.lit(-float(alpha)) / F.col("n"))
    both = (m > 0) & (m < n)
    best = q * (1 - F.pow(q, m)) / (1 - q)
    worst = best * F.pow(q, n - m)
    out = [
        *keys,
        F.when(F.col("__key") % 2 == 1, "mean").otherwise("min").alias("how"),
        F.shiftright("__key", 1).alias("mask"),
        n.alias("ligand_count"),
        m.alias("active_count"),
        F.when(both, (F.col("ranks") - m * (m + 1) / 2) / (m * (n - m))).otherwise(NAN).alias("roc_auc"),
        F.when(m > 0, F.col("precisions") / m).otherwise(NAN).alias("average_precision"),
        F.when(both, (F.col("seen") - worst) / (best - worst)).otherwise(NAN).alias("bedroc"),
    ]
    for i, f in enumerate(fractions):
        out.append(F.when(m > 0, (F.col(f"h{i}") / top_count(n, f)) / (m / n)).otherwise(NAN).alias(f"ef{round(100 * f)}"))
    return found.select(*out)

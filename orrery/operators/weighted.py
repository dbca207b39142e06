"""Bootstrap metrics by weights: a row counts as often as its unit was drawn, and is never copied.

An attempt draws as many units as there are, with replacement. Attempts come in blocks; for
each block a unit carries one small array with its counts. The rows of a key are sorted once,
in pieces of the order that many tasks share, and each piece gives for all attempts of a
block its weight, its weight of actives, their decays and their wins inside the piece.
These add up along the pieces, as decays only take the factor of the weight before them and
wins only the decoys after them. So 5,000 draws cost one pass over rows times blocks.
Where units are few (whole groups are drawn), their counts go to all tasks and rows bear
no counts: they are shuffled once, whatever the number of attempts. Where each unit is one
row of a key and keys need not share their draws, a piece makes its own: an attempt's draws
are first dealt to the pieces by a multinomial law, and inside a piece to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators.order import score_piece
from orrery.operators.resample import interval, numbered

#: Attempts in a block; units whose draws a task makes at a time; rows of a piece.
BLOCK, DRAWS, PIECE_ROWS = 250, 1 << 16, 2048
#: Totals by key and attempt go to all tasks; so many at a time.
TOTALS = 1 << 20
#: Units, at most, whose counts go to all tasks (1,024 units, 5,000 attempts: 10 MB); those up to which weights are products of matrices; rows at a time.
FEW, DENSE, PART = 1024, 64, 2048
ALPHA = 20.0


def _drawn(seed: int, most: int):
    """Counts of a piece of the units, by position: for each attempt a generator of its own.

    Where units are more than a piece, an attempt's draws are first shared out among the pieces
    by a multinomial law, alike in every task; so each unit is in one piece only.
    """

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for batch in batches:
            for stratum, n, piece, block in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                first, mark = piece * most, zlib.crc32(stratum.encode())
                size, sizes = min(most, n - first), np.minimum(most, n - np.arange(0, n, most))
                counts = np.empty((BLOCK, size), np.uint8)
                for j in range(BLOCK):
                    attempt = block * BLOCK + j
                    share = n if n <= most else np.random.default_rng([seed, mark, len(sizes), attempt]).multinomial(n, sizes / n)[piece]
                    times = np.bincount(np.random.default_rng([seed, mark, piece, attempt]).integers(0, size, share), minlength=size)
                    if times.max() > 255:
                        raise OverflowError("a unit was drawn more often than a byte holds")
                    counts[j] = times
                held = counts.any(axis=0)
                at, counts = first + np.flatnonzero(held), np.ascontiguousarray(counts.T[held])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stratum] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(np.full(len(at), block), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())],
                    names=["stratum", "at", "block", "counts"],
                )

    return run


def unit_counts(units: DataFrame, unit: str, blocks: Sequence[int], seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """``unit, block, counts``: how often each unit is drawn in each attempt of a block; units that are not drawn have no row."""
    stratum = F.to_json(F.struct(*strata)) if strata else F.lit("")
    every = numbered(units, unit, strata).select(unit, stratum.alias("stratum"), F.col("__at").cast("long").alias("at"), "__n")
    sizes = every.groupBy("stratum").agg(F.max("__n").alias("n"))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / DRAWS)))
    asked = sizes.withColumn("piece", pieces).select("stratum", "n", "piece", F.explode(F.lit(list(blocks))).alias("block"))
    counts = asked.repartition("stratum", "piece", "block").mapInArrow(_drawn(seed, DRAWS), "stratum string, at long, block int, counts binary")
    return counts.hint("merge").join(every.drop("__n"), ["stratum", "at"]).select(unit, "block", "counts")


def _counts(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BLOCK)


def _add_sorted(out: np.ndarray, to: np.ndarray, w: np.ndarray) -> None:
    """Adds each row of ``w`` to the row ``to`` (never falling) of ``out``."""
    if len(to):
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        out[to[first]] = np.add.reduceat(w, first, axis=0, dtype=out.dtype)


def _whole(w: np.ndarray) -> type:
    """What sums of counts along ``w`` fit in."""
    return np.int32 if len(w) * np.iinfo(w.dtype).max < 1 << 31 else np.int64


def _stretches(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place ``at`` (rising) the sum of the rows of ``w`` before it."""
    kind = _whole(w)
    if not len(at):
        return np.zeros((0, BLOCK), kind)
    out = np.zeros((len(at), BLOCK), kind)
    if at[0]:
        out[0] = w[: at[0]].sum(axis=0, dtype=kind)
    if len(at) > 1:
        out[1:] = np.add.reduceat(w[: at[-1]], at[:-1], axis=0, dtype=kind)
    return np.cumsum(out, axis=0, dtype=kind)


def _sum_units(batches: Iterator) -> Iterator:
    """Totals by key and attempt of batches (key, n, block, counts)."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        places: dict = {}
        where = np.array([places.setdefault(k, len(places)) for k in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)])
        order = np.argsort(where, kind="stable")
        w, n = _counts(batch.column(3))[order], batch.column(1).to_numpy()[order]
        sums = np.zeros((len(places), BLOCK), np.int64)
        _add_sorted(sums, where[order], w if (n == 1).all() else w * n[:, None])
        attempts = np.concatenate([b * BLOCK + np.arange(BLOCK) for _, b in places])
        keys = [k for k, _ in places for _ in range(BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(attempts, pa.int64()), pa.array(sums.ravel())], names=["key", "attempt", "n"])


PIECE_SCHEMA = "key string, block int, piece long, w binary, a binary, s binary, l binary"


#: Sums that each metric is made of; the others are not computed.
SUMS = {"roc_auc": "l", "bedroc": "s"}


def _local(totals: dict, asked: Sequence[str] = tuple(SUMS)):
    """What a piece adds, for the attempts of a block: weight, actives, decays of actives from the piece's start, wins inside (the last two where asked for)."""
    sums = {SUMS[m] for m in asked}

    def run(key, table):
        name, block, piece = (k.as_py() for k in key)
        table = table.sort_by([("score", "ascending"), ("id", "ascending")])
        # A unit's draws may come in several parts; repeats of a row stand together either way.
        w, active = _counts(table.column("counts")), table.column("active").to_numpy().astype(bool)
        return _piece_rows([(name, block, piece, *_sums_of(w, active, table.column("score").to_numpy(), totals[name, block], sums))])

    return run


def _sums_of(w: np.ndarray, active: np.ndarray, score: np.ndarray, n: np.ndarray, sums: set) -> tuple:
    """Weight, actives, decays and wins of sorted rows by their counts ``w``; ``n`` is the weight of the whole key."""
    drawn, mine = w.sum(axis=0, dtype=np.int64), w[active].sum(axis=0, dtype=np.int64)
    decay = wins = np.zeros(BLOCK)
    if "s" in sums:
        at = np.flatnonzero(active)
        # Weights before each active: sums of the stretches between actives, then along these.
        before = _stretches(w, at)
        one = np.maximum(n, 1)
        q = np.exp(-ALPHA / one)
        most = int(w[at].max(initial=0)) + 1
        gained = q * (1 - q ** np.arange(most)[:, None]) / (1 - q)  # by how often a row was drawn
        decay = (np.exp(before * (-ALPHA / one)) * np.take_along_axis(gained, w[at].astype(np.intp), axis=0)).sum(axis=0)
    if "l" in sums:
        wins = _wins(w, active, score)
    return drawn, mine, decay, wins


def _wins(w: np.ndarray, active: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Pairs of an active and a later decoy, by their counts; ties are halves."""
    changes = np.concatenate([[True], score[1:] != score[:-1]])
    group = np.cumsum(changes) - 1
    decoys = np.zeros((int(changes.sum()), BLOCK), _whole(w))
    _add_sorted(decoys, group[~active], w[~active])
    upto = np.cumsum(decoys, axis=0, dtype=decoys.dtype)
    to = group[active]
    return (w[active] * (upto[-1] - upto[to] + 0.5 * decoys[to])).sum(axis=0)


def _piece_rows(rows: list[tuple]):
    """A table as in PIECE_SCHEMA."""
    import pyarrow as pa

    columns = [*zip(*[(*r[:3], *(x.astype(float).tobytes() for x in r[3:])) for r in rows], strict=True)] or [()] * 7
    fields = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(x, t) for x, t in zip(columns, fields, strict=True)], names=[f.split()[0] for f in PIECE_SCHEMA.split(", ")])


def _local_few(shared, asked: Sequence[str]):
    """What a piece adds, for the attempts of all blocks; ``shared`` holds the units, their counts by block, and the totals."""
    sums = {SUMS[m] for m in asked}

    def run(key, table):
        import pyarrow as pa
        import pyarrow.compute as pc

        name, piece = (k.as_py() for k in key)
        units, counts, totals = shared.value
        table = table.sort_by([("score", "ascending"), ("id", "ascending")])
        unit = pc.index_in(table.column("unit"), value_set=pa.array(units, table.schema.field("unit").type)).fill_null(-1).to_numpy()
        held = unit >= 0  # others are drawn in no attempt
        unit, active, score = unit[held], table.column("active").to_numpy().astype(bool)[held], table.column("score").to_numpy()[held]
        if not len(unit):
            return _piece_rows([])
        number = lambda x: np.bincount(x, minlength=len(units)).astype(float)
        every, actives = number(unit), number(unit[active])
        rate = {b: -ALPHA / np.maximum(totals[name, b], 1) for b in counts}
        decay = {b: np.zeros(BLOCK) for b in counts}
        if "s" in sums and active.any():
            steps = {b: w * rate[b] for b, w in counts.items()}  # by how much a row's unit moves those behind it
            gained = {b: np.exp(rate[b]) * np.expm1(steps[b]) / np.expm1(rate[b]) for b in counts}
            seen = np.zeros(len(units))
            for at in range(0, len(unit), PART):
                here, places = unit[at : at + PART], np.flatnonzero(active[at : at + PART])
                if len(units) <= DENSE:
                    ahead = np.zeros((len(here) + 1, len(units)))
                    ahead[0], ahead[np.arange(len(here)) + 1, here] = seen, 1
                    ahead = np.cumsum(ahead, axis=0)[places]
                for b in counts if len(places) else ():
                    moved = ahead @ steps[b] if len(units) <= DENSE else (seen @ counts[b] + _stretches(counts[b][here], places)) * rate[b]
                    decay[b] += np.einsum("ab,ab->b", np.exp(moved, out=moved), gained[b][here[places]])
                seen += number(here)
        none = np.zeros(BLOCK)
        return _piece_rows([(name, b, piece, every @ w, actives @ w, decay[b], _wins(w[unit], active, score) if "l" in sums else none) for b, w in counts.items()])

    return run


SHARE_SCHEMA = "key string, block int, piece long, stratum string, share binary, total binary"


def _shares(seed: int):
    """How many draws of each attempt of a block fall to each piece of a key, by stratum, and to the key as a whole.

    ``n`` units are drawn in a stratum; those that the key has no row of take their part, too.
    """

    def run(key, table):
        import zlib

        import pyarrow as pa

        name, block = (k.as_py() for k in key)
        table = table.sort_by([("stratum", "ascending"), ("piece", "ascending")])
        strata, size, n = np.array(table.column("stratum").to_pylist(), object), table.column("size").to_numpy(), table.column("n").to_numpy()
        share = np.zeros((len(size), BLOCK), np.int64)
        for stratum in dict.fromkeys(strata.tolist()):
            at = np.flatnonzero(strata == stratum)
            all_ = int(n[at[0]])
            p = np.append(size[at], all_ - size[at].sum()) / all_
            rng = np.random.default_rng([seed, zlib.crc32(name.encode()), zlib.crc32(stratum.encode()), block])
            share[at] = rng.multinomial(all_, p, BLOCK)[:, :-1].T
        columns = [[name] * len(size), [block] * len(size), table.column("piece").to_pylist(), strata.tolist(), [x.tobytes() for x in share], [share.sum(axis=0).tobytes()] * len(size)]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SHARE_SCHEMA.split(", ")])

    return run


def _dealt(rng: np.random.Generator, size: int, share: np.ndarray) -> np.ndarray:
    """Counts of ``size`` rows in the attempts of a block, each of which draws ``share`` of them with replacement."""
    counts = np.empty((size, BLOCK), np.uint8)
    step = max(1, (1 << 22) // max(1, int(share.max()), size))  # attempts at a time
    for a in range(0, BLOCK, step):
        of = share[a : a + step]
        at = rng.integers(0, size, int(of.sum())) * len(of) + np.repeat(np.arange(len(of)), of)
        times = np.bincount(at, minlength=size * len(of)).reshape(size, len(of))
        if times.max() > 255:
            raise OverflowError("a unit was drawn more often than a byte holds")
        counts[:, a : a + step] = times
    return counts


def _local_own(seed: int, asked: Sequence[str]):
    """What a piece (its rows, its shares by block and stratum) adds, from draws that it makes itself."""
    sums = {SUMS[m] for m in asked}

    def run(key, table, shares):
        import zlib

        name, piece = (k.as_py() for k in key)
        table = table.sort_by([("score", "ascending"), ("id", "ascending")])
        active, score = table.column("active").to_numpy().astype(bool), table.column("score").to_numpy()
        strata = np.array(table.column("stratum").to_pylist(), object)
        places = {x: np.flatnonzero(strata == x) for x in dict.fromkeys(strata.tolist())}
        blocks: dict = {}
        for block, stratum, share, total in zip(*(shares.column(c).to_pylist() for c in ("block", "stratum", "share", "total")), strict=True):
            blocks.setdefault(block, []).append((stratum, np.frombuffer(share, np.int64), np.frombuffer(total, np.int64)))
        out = []
        for block in sorted(blocks):
            w = np.zeros((len(active), BLOCK), np.uint8)
            for stratum, share, total in blocks[block]:
                rng = np.random.default_rng([seed, zlib.crc32(name.encode()), zlib.crc32(stratum.encode()), block, piece])
                w[places[stratum]] = _dealt(rng, len(places[stratum]), share)
            out.append((name, block, piece, *_sums_of(w, active, score, total, sums)))
        return _piece_rows(out)

    return run


def _own_parts(rows: DataFrame, fine: DataFrame, units: DataFrame, blocks: Sequence[int], seed: int, metrics: Sequence[str]) -> DataFrame:
    """Sums of pieces whose rows are units, with draws of each key's own; rows and shares are shuffled, counts are not."""
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # rows are small and slow, so their groups are not put together
    sizes = rows.groupBy("key", "fine", "stratum").agg(F.count(F.lit(1)).alias("c")).join(fine, ["key", "fine"]).groupBy("key", "piece", "stratum").agg(F.sum("c").alias("size"))
    sizes = sizes.join(units.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), "stratum").withColumn("block", F.explode(F.lit(list(blocks))))
    shares = sizes.groupBy("key", "block").applyInArrow(_shares(seed), SHARE_SCHEMA)
    placed = rows.join(fine, ["key", "fine"]).select("key", "piece", "score", "id", "stratum", "active").repartition(tasks, "key", "piece")
    return placed.groupBy("key", "piece").cogroup(shares.repartition(tasks, "key", "piece").groupBy("key", "piece")).applyInArrow(_local_own(seed, metrics), PIECE_SCHEMA)


def _along(key, table):
    """Metrics of the attempts of a block from its pieces in order."""
    import pyarrow as pa

    name, block = (k.as_py() for k in key)
    table = table.sort_by("piece")
    w, a, s, wins = (np.frombuffer(b"".join(table.column(c).to_pylist())).reshape(-1, BLOCK) for c in "wasl")
    n, m = w.sum(axis=0), a.sum(axis=0)
    one = np.maximum(n, 1)
    seen = (np.exp(-ALPHA * (np.cumsum(w, axis=0) - w) / one) * s).sum(axis=0)
    decoys = w - a
    won = (wins + a * (decoys.sum(axis=0) - np.cumsum(decoys, axis=0))).sum(axis=0)
    q = np.exp(-ALPHA / one)
    most = q * (1 - q**m) / (1 - q)
    least = most * q ** (n - m)
    both = (m > 0) & (m < n)
    with np.errstate(divide="ignore", invalid="ignore"):
        bedroc = np.where(both, (seen - least) / (most - least), np.nan)
        auc = np.where(both, won / (m * (n - m)), np.nan)
    attempt = block * BLOCK + np.arange(BLOCK)
    return pa.table({"key": [name] * BLOCK, "attempt": attempt, "roc_auc": auc, "bedroc": bedroc})


def _prepared(scores: DataFrame, keys: Sequence[str], unit: str = "ligand_id", strata: Sequence[str] = (), id_: str = "ligand_id", active: Column | None = None) -> DataFrame:
    """The columns that attempts are made of, written once."""
    from orrery.operators.folds import checkpointed

    key = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    active = F.col("label") == "active" if active is None else active
    return checkpointed(
        scores.select(
            *keys, key.alias("key"), F.col("score").cast("double").alias("score"), F.col(id_).alias("id"), F.col(unit).alias("unit"), active.cast("int").alias("active"), score_piece("score").alias("fine"), *[c for c in strata if c not in keys]
        )
    )


def weighted_metrics(scores: DataFrame, keys: Sequence[str], attempts: range, seed: int, unit: str = "ligand_id", strata: Sequence[str] = (), id_: str = "ligand_id", active: Column | None = None, metrics: Sequence[str] = tuple(SUMS)) -> DataFrame:
    """``*keys, attempt`` and the ``metrics`` (roc_auc, bedroc) of the drawn units; NaN where an attempt lacks one of the labels.

    Lower scores are better, ties go to the smaller id and a row's repeats stand together.
    ``attempts`` starts and ends at multiples of a block. Rows whose score or unit is null are left out.
    """
    return _attempted(_prepared(scores, list(keys), unit, strata, id_, active), list(keys), attempts, seed, strata, metrics)


def _attempted(rows: DataFrame, keys: list[str], attempts: range, seed: int, strata: Sequence[str], metrics: Sequence[str], joint: bool = True) -> DataFrame:
    """Metrics of attempts; all keys share the draws if they are ``joint``, which costs rows times attempts where units are many."""
    from orrery.operators.folds import checkpointed

    if attempts.start % BLOCK or attempts.stop % BLOCK:
        raise ValueError(f"attempts come in blocks of {BLOCK}")
    rows = rows.filter(F.col("score").isNotNull() & F.col("unit").isNotNull()).withColumn("stratum", F.to_json(F.struct(*strata)) if strata else F.lit(""))
    names = checkpointed(rows.select("key", *keys).distinct())
    many = names.count()
    fine = rows.groupBy("key", "fine").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("key").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.select("key", "fine", F.floor(F.coalesce(F.sum("c").over(upto), F.lit(0)) / PIECE_ROWS).alias("piece"))
    placed = rows.join(fine, ["key", "fine"]).select("key", "piece", "score", "id", "unit", "active")
    units = rows.select("unit", "stratum", *strata).distinct()
    few = units.count() <= FEW
    per_unit = rows.groupBy("key", "unit").agg(F.count(F.lit(1)).alias("n"))
    blocks = range(attempts.start // BLOCK, attempts.stop // BLOCK)
    if not few and not joint and per_unit.filter("n > 1").isEmpty() and units.groupBy("unit").count().filter("count > 1").isEmpty():
        parts = _own_parts(rows, fine, units, blocks, seed, metrics)
        found = parts.groupBy("key", "block").applyInArrow(_along, "key string, attempt long, roc_auc double, bedroc double")
        return found.join(names, "key").select(*keys, "attempt", *metrics)
    step = max(1, TOTALS // max(1, many * BLOCK))
    out = None
    for at in range(0, len(blocks), step):
        drawn = checkpointed(unit_counts(units, "unit", blocks[at : at + step], seed, strata))
        # Counts are many bytes a row, which the planner cannot know: their side is never broadcast.
        sums = per_unit.join(drawn.hint("merge"), "unit").select("key", "n", "block", "counts").mapInArrow(_sum_units, "key string, attempt long, n long")
        sums = sums.groupBy("key", "attempt").agg(F.sum("n").alias("n")).collect()  # one number for each key and attempt of these blocks
        totals: dict = {}
        for r in sums:
            totals.setdefault((r["key"], r["attempt"] // BLOCK), np.zeros(BLOCK))[r["attempt"] % BLOCK] = r["n"]
        if few:
            shared = rows.sparkSession.sparkContext.broadcast((*_unit_table(drawn), totals))
            parts = placed.groupBy("key", "piece").applyInArrow(_local_few(shared, metrics), PIECE_SCHEMA)
        else:
            parts = placed.join(drawn.hint("merge"), "unit").groupBy("key", "block", "piece").applyInArrow(_local(totals, metrics), PIECE_SCHEMA)
        found = parts.groupBy("key", "block").applyInArrow(_along, "key string, attempt long, roc_auc double, bedroc double")
        out = found if out is None else out.unionByName(found)
    return out.join(names, "key").select(*keys, "attempt", *metrics)


def _unit_table(drawn: DataFrame) -> tuple[list, dict[int, np.ndarray]]:
    """Units, of which there are few, and for each block their counts; draws of a unit in several strata add up."""
    rows = drawn.collect()  # at most FEW units and strata for each block
    units = list(dict.fromkeys(r["unit"] for r in rows))
    place = {u: i for i, u in enumerate(units)}
    counts = {b: np.zeros((len(units), BLOCK), np.uint16) for b in sorted({r["block"] for r in rows})}
    for r in rows:
        counts[r["block"]][place[r["unit"]]] += np.frombuffer(bytes(r["counts"]), np.uint8)
    return units, counts


def valid_draws(scores: DataFrame, keys: Sequence[str], metric: str, iterations: int, seed: int, joint: bool = True, **how) -> DataFrame:
    """``*keys, attempt, value, nth``: the first ``iterations`` attempts of each key whose metric is defined, at most twice as many being made.

    A key that has fewer by then is an error, as its units hardly ever hold both labels. Unless draws
    are ``joint``, keys with many units that are one row each draw for themselves.
    """
    from orrery.operators.folds import checkpointed

    keys = list(keys)
    whole = -(-iterations // BLOCK) * BLOCK
    order = Window.partitionBy(*keys).orderBy("attempt")
    rows, strata = _prepared(scores, keys, **how), how.get("strata", ())

    def made(attempts: range) -> DataFrame:
        found = _attempted(rows, keys, attempts, seed, strata, [metric], joint)
        return checkpointed(found.select(*keys, "attempt", F.col(metric).alias("value")).filter(~F.isnan("value")))

    def short(values: DataFrame) -> int:
        # By key, so the rows are as many as keys.
        return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") < iterations).count()

    n_keys = rows.select(*keys).distinct().count()
    values = made(range(0, whole)).filter(F.col("attempt") < 2 * iterations)
    if short(values) or values.select(*keys).distinct().count() < n_keys:
        more = made(range(whole, 2 * whole)).filter(F.col("attempt") < 2 * iterations)
        values = values.unionByName(more)
        if short(values) or values.select(*keys).distinct().count() < n_keys:
            raise ValueError(f"too few of {2 * iterations} draws hold both labels")
    return values.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= iterations)


def bootstrap(scores: DataFrame, keys: Sequence[str], metric: str, iterations: int, seed: int, unit: str = "ligand_id", strata: Sequence[str] = ()) -> DataFrame:
    """Interval of one metric per key over ``iterations`` valid draws; with a group column as ``unit`` whole groups are drawn."""
    values = valid_draws(scores, keys, metric, iterations, seed, joint=False, unit=unit, strata=strata)
    return _described(values, list(keys))


def paired_deltas(scores: DataFrame, key: str, metric: str, iterations: int, seed: int, unit: str = "ligand_id") -> DataFrame:
    """``a, b`` and the interval of metric(b) - metric(a) on the same draws, for every pair of key values with a before b."""
    values = valid_draws(scores, [key], metric, iterations, seed, unit=unit)
    one = values.select(F.col(key).alias("a"), "attempt", F.col("value").alias("x"))
    two = values.select(F.col(key).alias("b"), "attempt", F.col("value").alias("y"), "nth")
    both = one.join(two, "attempt").filter("a < b").select("a", "b", "attempt", "nth", (F.col("y") - F.col("x")).alias("value"))
    return _described(both, ["a", "b"])


def _described(values: DataFrame, keys: list[str]) -> DataFrame:
    skipped = values.groupBy(*keys).agg((F.max("attempt") + 1).cast("long").alias("attempts"))
    return interval(values, keys, "value").drop("skipped").join(skipped, keys)

"""Mixing sources to target weights by pivotal dependent rounding.

A document of source s is wanted ``target(s) / size(s)`` times. The integral part is
taken as it is; the fractional part is rounded. Fractional documents are paired and
mass moves at random within the pair until one of the two is integral, such that the
expected words of the pair, and so of the source, do not change. Groups of documents
are rounded side by side; each leaves one residual per source at most, and residuals
meet in a reduction tree until one per source is left, which alone is drawn by chance.
A source is therefore off its target by less than its largest document.

Equal rows are one item that is wanted as often as all of them together, so a row that makes
up a third of the table is rounded in one step, and its copies are then dealt out evenly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.llm.common import cut, n_words, numbered_copies, row_hashes

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
LEAF_ROWS = 4096
FAN_IN = 64
SEED = 71


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources take the weights in turn by code point, null last. Where a share exceeds
    ``cap`` times the source, the excess goes to the others by weight: with sources in
    order of cap per weight, a prefix of them is capped and the rest share what is left.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))  # one row a source
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    w = by_source.withColumn("w", weight).withColumn("most", cap * F.col("source_size"))
    ordered = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - (F.sum("most").over(up_to) - F.col("most"))) / (
        F.sum("w").over(everything) - (F.sum("w").over(up_to) - F.col("w"))
    )
    w = w.withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct(F.col("most") / F.col("w"), "source", "level")))
    first = free.over(everything)["level"]
    return w.select("source", "source_size", F.least("most", F.coalesce(first * F.col("w"), "most")).alias("target"))


def round_masses(masses, sizes, draw) -> tuple[list[float], int]:
    """Pivotal rounding of one source's rows in order; the residual's index, or -1.

    ``sum(mass * size)`` stays the same. ``draw()`` gives uniform numbers.
    """
    out, held = list(masses), -1
    for i, mass in enumerate(out):
        if not 0.0 < mass < 1.0:
            continue
        if held < 0:
            held = i
            continue
        p, ratio = out[held], sizes[held] / sizes[i]
        up = min(1.0 - p, mass / ratio)
        down = min(p, (1.0 - mass) / ratio)
        if draw() * (up + down) < down:
            q, r = p + up, mass - up * ratio
            q, r = (1.0, r) if up == 1.0 - p else (q, 0.0)
        else:
            q, r = p - down, mass + down * ratio
            q, r = (0.0, r) if down == p else (q, 1.0)
        q, r = min(max(q, 0.0), 1.0), min(max(r, 0.0), 1.0)
        out[held], out[i] = q, r
        held = held if 0.0 < q < 1.0 else i if 0.0 < r < 1.0 else -1
    return out, held


def _rounder(level: int, last: bool, seed: int):
    def run(rows):
        import random

        import numpy as np
        import pyarrow as pa

        turn, a, b = (rows.column(k).to_numpy() for k in ("turn", "a", "b"))
        order = np.lexsort((b, a, turn))
        mass, size = rows.column("mass").to_numpy()[order], rows.column("size").to_numpy()[order].tolist()
        turn, leaf = turn[order], rows.column("leaf")[0].as_py()
        edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]
        for i, j in zip(edges, edges[1:], strict=False):
            rng = random.Random(f"{seed}|{level}|{leaf}|{turn[i]}")
            done, held = round_masses(mass[i:j].tolist(), size[i:j], rng.random)
            if last and held >= 0:
                done[held] = float(rng.random() < done[held])
            mass[i:j] = done
        rows = rows.take(pa.array(order))
        return rows.set_column(rows.schema.get_field_index("mass"), "mass", pa.array(mass))

    return run


def mix_items(items: DataFrame, targets: DataFrame, cap: float, seed: int) -> DataFrame:
    """``items (a, b, source, size, n)``, equal rows as one with their number ``n``: how many ``copies`` of all n are taken."""
    items = items.join(targets.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    want = F.when(F.col("size") > 0, F.col("n") * F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))
    leaves = 1
    rows = items.count()
    while leaves * LEAF_ROWS < rows:
        leaves *= 2
    fields = ["a", "b", "n", "turn", "size", "source_size", "target", "base", "mass", "leaf"]
    frame = items.withColumn("want", want).select(
        "a",
        "b",
        "n",
        F.xxhash64("source", F.col("source").isNull()).alias("turn"),
        "size",
        "source_size",
        "target",
        F.floor("want").cast("long").alias("base"),
        (F.col("want") - F.floor("want")).alias("mass"),
        F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(leaves)).alias("leaf"),
    )
    parts, level = [], 0
    open_ = (F.col("mass") > 0) & (F.col("mass") < 1)
    while True:
        last = leaves == 1
        keys: list[Column] = [F.col("leaf")] if level == 0 else [F.col("leaf"), F.pmod("turn", F.lit(16)).alias("slice")]
        done = frame.groupBy(*keys).applyInArrow(_rounder(level, last, seed), frame.schema)
        done = cut(done.select(*fields))
        parts.append(done.filter(~open_))
        if last:
            break
        frame = done.filter(open_).withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("long"))
        leaves, level = -(-leaves // FAN_IN), level + 1
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.select("a", "b", "n", "size", "source_size", "target", (F.col("base") + F.col("mass").cast("long")).alias("copies"))


def mix_decisions(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, copies, taken``.

    Rows are equal if ``doc_id, source`` and ``text`` are; their copies differ by one at most.
    Null or empty texts have size 0 and are never taken. Sources that tie in cap per weight
    are ordered by name, null last. An empty table gives no rows. Draws are keyed by what
    rows hold, so the order in which they come does not matter.
    """
    key = docs.select("doc_id", "source", "text")
    a, b = row_hashes(key)
    sized = key.select("doc_id", "source", a.alias("a"), b.alias("b"), n_words(F.col("text")).alias("size"))
    items = sized.groupBy("a", "b").agg(*[F.first(x).alias(x) for x in ("doc_id", "source", "size")], F.count(F.lit(1)).alias("n"))
    items = cut(items)
    made = mix_items(items.drop("doc_id"), source_targets(sized, weights, cap), cap, seed)
    made = made.join(items.select("a", "b", "doc_id"), ["a", "b"])
    each = numbered_copies(made, "n", "__i", items.agg(F.max("n")).first()[0], "a", "b")
    copies = (F.floor(F.col("copies") / F.col("n")) + (F.col("__i") <= F.col("copies") % F.col("n")).cast("long")).cast("int")
    each = each.withColumn("copies", copies)
    return each.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, in the same columns.

    Rows are equal if all their columns are; they may bear any names and types. A null id is
    an id like others here.
    """
    fields = docs.columns
    a, b = row_hashes(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in fields])
    held = docs.select(a.alias("a"), b.alias("b"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"), row.alias("row"))
    sized = held.select("a", "b", "source", "size")
    items = sized.groupBy("a", "b").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    items = cut(items)
    made = mix_items(items, source_targets(sized, weights, cap), cap, seed).filter("copies > 0").select("a", "b", "copies")
    most = items.agg(F.max("n")).first()[0]  # a row has at most about ``cap`` times its size, so so many copies and a few
    # One of equal rows stands for all; they meet on the map side first.
    one = held.groupBy("a", "b").agg(F.first("row").alias("row"))
    joined = numbered_copies(one.join(made, ["a", "b"]), "copies", "__copy", most and int(most * max(1, cap)), "a", "b")
    return joined.select(*[F.col("row")[c].alias(c) for c in fields])


def query(docs: DataFrame) -> DataFrame:
    return mix_decisions(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")

"""Embedding whitening by a tall-skinny QR: no covariance matrix is formed.

Rows become vectors of whole numbers. Each distinct vector, once, is centred with exact
sums, every partition is reduced to the R factor of its rows, R factors are merged in a
tree, and the singular values and right vectors of the last one give the whitening. A
factor has as many rows and columns as the vectors have entries, however many rows there
are; it is all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut

SCALE, COMPONENTS = 256, 4
#: R factors that one task of the tree merges; numbers of vectors held at a time.
FAN, NUMBERS = 16, 1 << 20


def whole_numbers(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``rows`` whose vector has only finite entries, with those as whole numbers in ``__x``.

    Rows with a null or empty vector, null or non-finite entries, or entries that exceed a
    long after scaling are left out. Entries are floor(scale * entry).
    """
    usable = F.col(f"`{vector}`").isNotNull() & (F.size(f"`{vector}`") > 0)
    usable &= F.forall(f"`{vector}`", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < F.lit(2.0**62)))
    whole = F.transform(f"`{vector}`", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return rows.filter(usable).withColumn("__x", whole)


def blocks(column, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """Start and rows of an Arrow list column whose lists have ``d`` entries, some at a time."""
    step = max(1, NUMBERS // d)
    for at in range(0, len(column), step):
        part = column.slice(at, step)
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centre:
    """Exact means: whole part and remainder of each sum over ``n``."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray):
        """Sums of (n*x - S)^2, exact, as Arrow decimals."""
        import pyarrow as pa

        far = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if far * far * x.shape[1] < 1 << 63:
            u = self.n * x - np.array(self.sums, np.int64)
            return pa.array((u * u).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        u = self.n * x.astype(object) - np.array(self.sums, object)
        return pa.array([Decimal(int(v)) for v in (u * u).sum(axis=1)], pa.decimal128(38, 0))


def fitted_sums(fit: DataFrame, d: int) -> Centre | None:
    """Number of vectors and exact sums of every entry; None without vectors."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, sums = 0, np.zeros(d, object)
        for batch in batches:
            for _, x in blocks(batch.column(0), d):
                small = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
                sums += (x if small else x.astype(object)).sum(axis=0).astype(object)
                n += len(x)
        places = [*range(-1, d)] if n else []
        values = [Decimal(int(v)) for v in [n, *sums]] if n else []
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["place", "value"])

    total = fit.mapInArrow(run, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").cast("decimal(38,0)").alias("value"))
    found = {r["place"]: int(r["value"]) for r in total.collect()}  # one row for each entry of a vector
    return Centre(found[-1], [found[i] for i in range(d)]) if found else None


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def last_factor(fit: DataFrame, d: int, centre: Centre, fan: int = FAN) -> np.ndarray:
    """The R factor of all centred rows: one for each partition, merged in a tree."""

    def first(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        r = np.zeros((0, d))
        for batch in batches:
            for _, x in blocks(batch.column(0), d):
                r = _triangle(np.vstack([r, centre.apply(x)]))
        if len(r):
            context = TaskContext.get()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def merge(key, table):
        import pyarrow as pa

        r = np.zeros((0, d))
        for value in table.sort_by("part").column("r"):
            r = _triangle(np.vstack([r, value.values.to_numpy().reshape(-1, d)]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    factors = cut(fit.mapInArrow(first, "part long, r array<double>"))
    parts = factors.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        factors = factors.groupBy(F.floor(F.col("part") / fan).alias("up")).applyInArrow(merge, "part long, r array<double>")
        parts = -(-parts // fan)
    return np.array(factors.first()["r"]).reshape(-1, d)


def _projected(d: int, centre: Centre, across: np.ndarray, long: bool) -> Callable:
    """Of batches (columns beside, x): those columns, then deviation and whitened; a row for each component if ``long``."""
    k = across.shape[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, x in blocks(batch.column(batch.num_columns - 1), d):
                beside = batch.slice(at, len(x)).columns[:-1]
                w = centre.apply(x) @ across
                if long:
                    again = pa.array(np.repeat(np.arange(len(x)), k))
                    columns = [c.take(again) for c in [*beside, centre.deviation(x)]]
                    columns += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(w.ravel())]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "component", "whitened"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    return run


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding", scale: int = SCALE, fan: int = FAN) -> DataFrame:
    """For each usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Usable rows are those of ``whole_numbers`` whose vectors have as many entries as most
    distinct vectors have (of equally many, the longer ones). The fit takes each distinct
    vector once; repeated rows, rows that share an id and rows with a null id each get rows of
    their own. ``deviation`` is decimal(38,0), exact at any size. Components without variance
    are left out, as they cannot be scaled; so one distinct vector, or an empty table, gives
    no rows. Equal eigenvalues give some basis of their space. Signs are such that the largest
    entry of a component is positive. Other columns of ``rows`` are not looked at.
    """
    spark = rows.sparkSession
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), component int, whitened double"
    kept = whole_numbers(rows.select("vec_id", F.col(f"`{vector}`").alias("__v")), "__v", scale).select("vec_id", "__x")
    fit = cut(kept.select("__x").distinct())
    most = fit.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    none = spark.createDataFrame([], f"{schema}, n long, explained double, identity_error double")
    order = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if most is None:
        return none.select(order)
    d = most["d"]
    fit = fit.filter(F.size("__x") == d)
    centre = fitted_sums(fit, d)
    r = last_factor(fit, d, centre, fan)
    _, s, v = np.linalg.svd(r, full_matrices=False)
    usable = int((s > s[0] * max(r.shape) * np.finfo(float).eps).sum())
    if not usable:
        return none.select(order)
    k = min(components, usable)
    v = v[:k] * np.sign(v[np.arange(k), np.abs(v[:k]).argmax(axis=1)])[:, None]
    spread = s * s / centre.n
    across = (v / np.sqrt(spread[:k, None])).T
    names = [f"w{i}" for i in range(k)]
    seen = fit.mapInArrow(_projected(d, centre, across, False), ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = seen.agg(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    explained = F.get(F.lit([float(x) for x in spread[:k] / spread.sum()]), F.col("component") - 1)
    out = kept.filter(F.size("__x") == d).mapInArrow(_projected(d, centre, across, True), schema)
    return out.withColumns({"n": F.lit(centre.n).cast("long"), "explained": explained, "identity_error": F.lit(float(error))}).select(order)


def query(embeddings: DataFrame) -> DataFrame:
    """Four components; ``deviation`` as a long (beyond some millions of rows it no longer fits and the cast fails)."""
    return whiten(embeddings).withColumn("deviation", F.col("deviation").cast("long"))

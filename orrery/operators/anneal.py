"""Simulated annealing of quadratic objectives: seeded Metropolis sweeps over coefficient rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READS, SWEEPS = 50, 200


def metropolis(h: np.ndarray, j: np.ndarray, reads: int, sweeps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """States (reads by variables, 0 or 1) and energies after sweeps from hot to cold; ``j`` is symmetric without a diagonal.

    The first temperature accepts about half of the largest single step, the last one about one in
    a hundred of the smallest.
    """
    x = rng.integers(0, 2, (reads, len(h)))
    steps = np.abs(h) + np.abs(j).sum(axis=1)
    small = np.concatenate([np.abs(h[h != 0]), np.abs(j[j != 0])])
    if not len(small):
        return x, np.zeros(reads)
    hot, cold = np.log(2) / steps.max(), np.log(100) / small.min()
    best, low = x.copy(), x @ h + 0.5 * ((x @ j) * x).sum(axis=1)
    energy = low.copy()
    for beta in np.geomspace(hot, max(cold, hot), sweeps):
        for i in rng.permutation(len(h)):
            rise = (1 - 2 * x[:, i]) * (h[i] + x @ j[:, i])
            flip = (rise <= 0) | (rng.random(reads) < np.exp(-beta * np.maximum(rise, 0)))
            x[flip, i] ^= 1
            energy += np.where(flip, rise, 0)
            better = energy < low - 1e-12
            best[better], low[better] = x[better], energy[better]
    return best, best @ h + 0.5 * ((best @ j) * best).sum(axis=1)


def anneal(linear: DataFrame, quadratic: DataFrame, keys: Sequence[str], seeds: Sequence[int], reads: int = READS, sweeps: int = SWEEPS) -> DataFrame:
    """``*keys, seed, mask, energy, hits``: per problem and seed the lowest state found, without the constant, and how many reads reached it.

    ``linear``: keys, member (0 to 62), h. ``quadratic``: keys, a, b, j. A problem is as large
    as its pool of scorers; problems and seeds are spread over the tasks.
    """
    keys = list(keys)
    hs = linear.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("member").cast("int").alias("member"), F.col("h").cast("double").alias("h")))).alias("hs"))
    js = quadratic.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("j").cast("double").alias("j")))).alias("js"))
    both = hs.join(js, keys, "left").withColumn("seed", F.explode(F.lit(list(seeds))))
    both = both.select(*keys, F.xxhash64(*keys).alias("mark") if keys else F.lit(0).cast("long").alias("mark"), "seed", "hs", "js")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = batch.slice(0).to_pylist()
            found = []
            for r in rows:
                members = [m["member"] for m in r["hs"]]
                at = {m: i for i, m in enumerate(members)}
                h, j = np.array([m["h"] for m in r["hs"]]), np.zeros((len(at), len(at)))
                for p in r["js"] or []:
                    j[at[p["a"]], at[p["b"]]] = j[at[p["b"]], at[p["a"]]] = p["j"]
                x, energy = metropolis(h, j, reads, sweeps, np.random.default_rng([r["seed"], r["mark"] & (2**63 - 1)]))
                low = energy.min()
                masks = [sum(1 << m for m, on in zip(members, row, strict=True) if on) for row in x[energy <= low + 1e-9]]
                found.append((min(masks), float(low), len(masks)))
            columns = [batch.column(i) for i in range(len(keys))] + [batch.column(len(keys) + 1)]
            columns += [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "seed", "mask", "energy", "hits"])

    fields = ", ".join(f"{k} {linear.schema[k].dataType.simpleString()}" for k in keys)
    return both.repartition(*keys, "seed").mapInArrow(run, f"{fields}{', ' if keys else ''}seed int, mask long, energy double, hits long")

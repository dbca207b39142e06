"""Contexts and pairs are made where rows are read; rows of neither are shuffled or stored."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import objective as obj
from orrery.operators import ranking, ranksums
from orrery.operators import subsets as sub


def table(spark, n=120, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = "active" if rng.random() < 0.25 else "decoy"
        for k in ("p", "q"):
            rows += [(k, i * 7 % n, label, m, None if m == 1 and i == 5 else 4.0 if m == 2 and k == "q" else round(-5 * rng.random(), 1), i % 3) for m in range(3) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "kind string, ligand_id long, label string, receptor_id int, score double, fold int").localCheckpoint()


@pytest.mark.parametrize("stored", [1 << 32, 500])
def test_contexts_of_wide_rows_give_the_metrics_of_context_rows(spark, monkeypatch, stored):
    monkeypatch.setattr(ranksums, "STORED", stored)
    df, subsets, keys = table(spark), sub.k_subsets(spark, (0, 1, 2)), ["kind", "a", "b", "part"]
    bounds = obj.context_bounds(df, 3, ["kind"])
    rows = obj.context_rows(df, 3, ["kind"], bounds).localCheckpoint()
    want = {tuple(r[:6]): r for r in ranksums.subset_metrics(rows, subsets, (0, 1, 2), keys).collect()}
    wide = obj.context_wide(df, bounds, (0, 1, 2), ["kind"])
    got = {tuple(r[:6]): r for r in ranksums.subset_metrics(rows, subsets, (0, 1, 2), keys, wide=wide).collect()}
    assert set(got) == set(want) and len(got) > 300
    for k, r in got.items():
        assert tuple(r[6:]) == pytest.approx(tuple(want[k][6:]), abs=1e-12, nan_ok=True)


def test_rank_correlations_are_those_of_joined_pairs(spark):
    df = table(spark).filter("score is not null").union(spark.createDataFrame([("one", 1, "decoy", 0, 1.0, 0), ("one", 1, "decoy", 1, 2.0, 0)], "a string, b long, c string, d int, e double, f int"))
    placed = ranking.average_rank(df, ["kind", "receptor_id"], "score")
    of = lambda x, r: placed.select("kind", "ligand_id", F.col("receptor_id").alias(x), F.col("average_rank").alias(r))
    both = of("x", "rx").join(of("y", "ry"), ["kind", "ligand_id"]).filter("x < y")
    want = {tuple(r[:3]): max(0.0, r[3]) for r in ranking.pearson(both, ["kind", "x", "y"], "rx", "ry").select("kind", "x", "y", F.round("r", 6)).collect()}
    found = obj.rank_correlations(df, ["kind"])
    got = {tuple(r[:3]): r[3] for r in found.collect()}
    assert set(got) == set(want) and got == pytest.approx(want, abs=1e-6) and got["one", 0, 1] == 1.0
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("__held")[0]
    assert np.isfinite(list(got.values())).all()

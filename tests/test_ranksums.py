"""Metrics of all subsets from runs of sorted scores, against the rows of every subset."""

import random

import numpy as np
import pytest

from orrery.operators import objective as obj
from orrery.operators import ranking, ranksums
from orrery.operators import subsets as sub


def rows_of(rng, n, low, high, missing=0.0):
    out = []
    for i in range(n):
        label = "active" if rng.random() < 0.2 else "decoy"
        for k in ("p", "q"):
            out += [(k, rng.choice([-1, 0]), i * 7 % n, label, m, rng.randint(low, high)) for m in range(3) if rng.random() >= missing]
    return [(k, int(lig) % 3, lig, label, m, s) for k, _, lig, label, m, s in out]


@pytest.mark.parametrize("low, high, missing, pieces", [(0, 20, 0.0, 1 << 19), (-5, 10**9, 0.0, 40), (0, 6, 0.3, 25)])
def test_subset_metrics_are_those_of_the_rows_of_each_subset(spark, monkeypatch, low, high, missing, pieces):
    monkeypatch.setattr(ranksums, "PIECE_ROWS", pieces)
    monkeypatch.setattr(ranksums, "CHUNK", 50)
    rows = rows_of(random.Random(high), 300, low, high, missing)
    df = spark.createDataFrame(rows, "kind string, part int, ligand_id long, label string, receptor_id int, score long").localCheckpoint()
    subsets, keys = sub.k_subsets(spark, (0, 1, 2)), ["kind", "part"]
    got = {tuple(r[:4]): r.asDict() for r in ranksums.subset_metrics(df, subsets, (0, 1, 2), keys).collect()}
    made = obj.ensemble_scores(df, subsets, keys)
    want = {tuple(r[:4]): r.asDict() for r in ranking.metrics(made, [*keys, "how", "mask"], top=0).collect()}
    assert set(got) == set(want) and len(got) == 2 * 3 * 11
    for key, row in got.items():
        for name, value in row.items():
            other = want[key][name]
            assert value == other or abs(value - other) < 1e-12 or (np.isnan(value) and np.isnan(other)), (key, name, value, other)


def test_runs_come_back_and_are_no_rows():
    rng = np.random.default_rng(1)
    for high in (3, 10**5, 2**40):
        scores, active = np.sort(rng.integers(-high, high, 1000)), rng.random(1000) < 0.3
        low, run = ranksums.pack(scores, active)
        again, marks = ranksums.unpack(low, run, 1000)
        assert (again == scores).all() and (marks == active).all()
    assert len(ranksums.pack(np.zeros(1000, np.int64), active)[1]) < 2200  # two bytes and a bit a row, no ids
    x = rng.integers(0, 50, 1000)
    assert (ranksums.in_order(x) == np.argsort(x, kind="stable")).all()
    wide = x * 2**50
    assert (ranksums.in_order(wide) == np.argsort(wide, kind="stable")).all()

"""The weighted bootstrap against copied rows on the same draws, and the rule on draws without both labels."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import weighted

SCHEMA = "k string, ligand_id long, label string, group_id string, score double"


def scores(seed=2, n=60, ties=True):
    rng = random.Random(seed)
    out = []
    for k in ("x", "y"):
        for i in range(n):
            s = -rng.random() * 5
            out.append((k, i, "active" if i % 4 == 0 else "decoy", f"g{i % 11}", round(s, 1) if ties else s))
    return out


def brute(rows):
    """(AUC, BEDROC) of (score, id, active) rows with repeats, the best first."""
    rows = sorted(rows)
    n, m = len(rows), sum(r[2] for r in rows)
    if not 0 < m < n:
        return None, None
    wins = sum(0.5 * (a[0] == d[0]) + (a[0] < d[0]) for a in rows if a[2] for d in rows if not d[2])
    decay = [math.exp(-20 * r / n) for r in range(1, n + 1)]
    seen, most, least = sum(x for x, r in zip(decay, rows) if r[2]), sum(decay[:m]), sum(decay[n - m :])
    return wins / (m * (n - m)), (seen - least) / (most - least)


@pytest.mark.parametrize(("unit", "strata", "piece"), [("ligand_id", (), 2048), ("ligand_id", ("label",), 7), ("group_id", (), 5)])
def test_weights_agree_with_copied_rows(spark, monkeypatch, unit, strata, piece):
    monkeypatch.setattr(weighted, "PIECE_ROWS", piece)
    rows = scores()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    units = df.select(F.col(unit).alias("unit"), *strata).distinct()
    counts = defaultdict(lambda: np.zeros(weighted.BLOCK, int))
    for r in weighted.unit_counts(units, "unit", [0], 5, strata).collect():
        counts[r["unit"]] = counts[r["unit"]] + np.frombuffer(bytes(r["counts"]), np.uint8)
    n_units = units.count()
    assert (sum(counts.values()) == n_units).all()  # every attempt draws as many as there are
    if strata:
        actives = {r[1] for r in rows if r[2] == "active"}
        assert (sum(c for u, c in counts.items() if u in actives) == len(actives)).all()
    at = SCHEMA.split(", ").index(f"{unit} {'long' if unit == 'ligand_id' else 'string'}")
    found = {(r["k"], r["attempt"]): (r["roc_auc"], r["bedroc"]) for r in weighted.weighted_metrics(df, ["k"], range(0, weighted.BLOCK), 5, unit, strata).collect()}
    assert len(found) == 2 * weighted.BLOCK
    for (k, t), got in found.items():
        if t % 10:
            continue
        want = brute([(r[4], r[1], r[2] == "active") for r in rows if r[0] == k for _ in range(counts[r[at]][t])])
        assert got == pytest.approx(want, abs=1e-9)


def test_draws_in_several_parts_add_up(spark, monkeypatch):
    monkeypatch.setattr(weighted, "DRAWS", 16)
    df = spark.createDataFrame([(i,) for i in range(50)], "unit long")
    total = np.zeros(weighted.BLOCK, int)
    for r in weighted.unit_counts(df, "unit", [3], 9).collect():
        assert r["block"] == 3 and 0 <= r["unit"] < 50
        total += np.frombuffer(bytes(r["counts"]), np.uint8)
    assert (total == 50).all()


def test_draws_repeat_and_differ_by_seed(spark):
    df = spark.createDataFrame(scores(), SCHEMA)
    one = weighted.bootstrap(df, ["k"], "bedroc", 300, 7).orderBy("k").collect()
    assert one == weighted.bootstrap(df.repartition(5), ["k"], "bedroc", 300, 7).orderBy("k").collect()
    assert one != weighted.bootstrap(df, ["k"], "bedroc", 300, 8).orderBy("k").collect()
    assert [r["used"] for r in one] == [300, 300] and all(r["lower"] < r["mean"] < r["upper"] for r in one)


def test_draws_without_both_labels_are_replaced(spark):
    """Two of six groups hold actives only one of which is drawn now and then."""
    rows = [("x", i, "active" if i < 3 else "decoy", "a" if i < 3 else f"d{i}", -float(i)) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    r = weighted.bootstrap(df, ["k"], "roc_auc", 250, 3, unit="group_id").first()
    assert r["used"] == 250 and 250 < r["attempts"] <= 500
    values = weighted.valid_draws(df, ["k"], "roc_auc", 250, 3, unit="group_id").orderBy("nth").collect()
    assert [v["nth"] for v in values] == list(range(1, 251)) and values[-1]["attempt"] + 1 == r["attempts"]


def test_too_few_valid_draws_are_an_error(spark):
    df = spark.createDataFrame([("x", i, "decoy", "a", -float(i)) for i in range(5)], SCHEMA)
    with pytest.raises(ValueError, match="hold both labels"):
        weighted.bootstrap(df, ["k"], "roc_auc", 10, 3)


def test_every_pair_on_the_same_draws(spark):
    df = spark.createDataFrame(scores(ties=False), SCHEMA)
    same = df.unionByName(df.filter("k = 'x'").withColumn("k", F.lit("z")))
    out = {(r["a"], r["b"]): r for r in weighted.paired_deltas(same, "k", "roc_auc", 250, 4).collect()}
    assert set(out) == {("x", "y"), ("x", "z"), ("y", "z")}
    assert out["x", "z"]["mean"] == out["x", "z"]["lower"] == out["x", "z"]["upper"] == 0
    assert out["x", "y"]["mean"] == pytest.approx(-out["y", "z"]["mean"])


def test_each_unit_is_in_one_piece_of_the_draws():
    """Rows of counts are as many as units, however many pieces there are, and an attempt draws as many units as there are."""
    import pyarrow as pa

    n, most = 1000, 64
    batch = pa.RecordBatch.from_arrays([pa.array([""] * 16), pa.array([n] * 16), pa.array(range(16)), pa.array([3] * 16)], names=["stratum", "n", "piece", "block"])
    found = pa.Table.from_batches(weighted._drawn(5, most)(iter([batch])))
    at = found.column("at").to_pylist()
    assert len(at) == len(set(at)) and set(at) == set(range(n))
    counts = np.frombuffer(b"".join(found.column("counts").to_pylist()), np.uint8).reshape(-1, weighted.BLOCK)
    assert (counts.sum(axis=0, dtype=int) == n).all()
    assert abs(counts.var() - 1) < 0.05 and abs((counts == 0).mean() - np.exp(-1)) < 0.01


def test_a_piece_computes_only_what_its_metric_needs():
    import pyarrow as pa

    n = 50
    rng = np.random.default_rng(2)
    w = rng.integers(0, 4, (n, weighted.BLOCK)).astype(np.uint8)
    columns = {"score": rng.integers(0, 9, n) / 2, "id": range(n), "active": rng.integers(0, 2, n), "counts": pa.array([c.tobytes() for c in w])}
    key, totals = (pa.scalar("k"), pa.scalar(0, pa.int32()), pa.scalar(0)), {("k", 0): w.sum(axis=0).astype(float)}
    both, auc, bedroc = (weighted._local(totals, m)(key, pa.table(columns)) for m in (["roc_auc", "bedroc"], ["roc_auc"], ["bedroc"]))
    assert auc.column("l") == both.column("l") and bedroc.column("s") == both.column("s")
    assert not any(auc.column("s")[0].as_py()) and not any(bedroc.column("l")[0].as_py())

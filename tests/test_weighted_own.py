"""Many units of one row each: pieces make their own draws, and no row is joined with counts."""

import numpy as np
import pytest

from orrery.operators import weighted
from test_weighted import SCHEMA, brute, scores


@pytest.fixture
def many(monkeypatch):
    monkeypatch.setattr(weighted, "FEW", 0)
    monkeypatch.setattr(weighted, "PIECE_ROWS", 7)


@pytest.mark.parametrize(("strata", "metric"), [((), "bedroc"), (("label",), "roc_auc")])
def test_own_draws_follow_the_law_of_joint_ones(spark, monkeypatch, many, strata, metric):
    rows = [r for r in scores() if r[0] == "x" or r[1] % 3]  # y lacks a third of the units
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    joint = {(r["k"], r["attempt"]): r["value"] for r in weighted.valid_draws(df, ["k"], metric, 2000, 5, strata=strata).collect()}

    def refuse(*_):
        raise AssertionError("rows are joined with the draws of their units")

    monkeypatch.setattr(weighted, "_local", refuse)
    monkeypatch.setattr(weighted, "unit_counts", refuse)
    own = {(r["k"], r["attempt"]): r["value"] for r in weighted.valid_draws(df, ["k"], metric, 2000, 5, joint=False, strata=strata).collect()}
    for k in "xy":
        a, b = (np.array([v for (x, _), v in d.items() if x == k]) for d in (joint, own))
        assert len(a) == len(b) == 2000
        assert abs(a.mean() - b.mean()) < 5 * np.sqrt(2 / 2000) * a.std() and 0.9 < a.std() / b.std() < 1.1
    r = weighted.bootstrap(df, ["k"], metric, 250, 3, strata=strata).orderBy("k").collect()
    assert r == weighted.bootstrap(df.repartition(5), ["k"], metric, 250, 3, strata=strata).orderBy("k").collect()


def test_pieces_give_the_metrics_of_their_copied_rows(spark):
    import pyarrow as pa

    rows = sorted((r[4], r[1], int(r[2] == "active")) for r in scores() if r[0] == "x")
    n, cuts, parts, counts = len(rows), (0, 20, 45, 60), [], []
    sizes = pa.table({"piece": [0, 1, 2], "stratum": [""] * 3, "size": [20, 25, 15], "n": [n] * 3})
    shares = weighted._shares(4)((pa.scalar("x"), pa.scalar(0, pa.int32())), sizes)
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        s, d, y = zip(*rows[a:b], strict=True)
        table = pa.table({"score": s, "id": d, "active": y, "stratum": [""] * (b - a)}).take(list(range(b - a))[::-1])
        parts.append(weighted._local_own(4, list(weighted.SUMS))((pa.scalar("x"), pa.scalar(i)), table, shares.slice(i, 1)))
        rng = np.random.default_rng([4, __import__("zlib").crc32(b"x"), 0, 0, i])
        counts.append(weighted._dealt(rng, b - a, np.frombuffer(shares.column("share")[i].as_py(), np.int64)))
    w = np.concatenate(counts)
    assert (w.sum(axis=0) == n).all() and abs(w.var() - 1) < 0.1
    got = weighted._along((pa.scalar("x"), pa.scalar(0, pa.int32())), pa.concat_tables(parts))
    for t in range(0, weighted.BLOCK, 25):
        want = brute([r for r, c in zip(rows, w[:, t], strict=True) for _ in range(c)])
        assert (got.column("roc_auc")[t].as_py(), got.column("bedroc")[t].as_py()) == pytest.approx(want, abs=1e-9)

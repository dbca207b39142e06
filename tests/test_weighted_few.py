"""Few units: their counts go to all tasks, rows are not joined with draws."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import weighted
from test_weighted import SCHEMA, scores


def found(df, unit, strata=()):
    rows = weighted.weighted_metrics(df, ["k"], range(0, 2 * weighted.BLOCK), 5, unit, strata).collect()
    return {(r["k"], r["attempt"]): (r["roc_auc"], r["bedroc"]) for r in rows}


@pytest.mark.parametrize(("unit", "strata", "dense", "part"), [("group_id", (), 64, 2048), ("group_id", ("label",), 64, 3), ("ligand_id", (), 4, 4)])
def test_few_units_agree_with_draws_joined_to_rows(spark, monkeypatch, unit, strata, dense, part):
    df = spark.createDataFrame([*scores(), ("x", 999, "active", None, -9.0), ("y", 998, "decoy", "g1", None)], SCHEMA).repartition(3)
    for name, value in (("PIECE_ROWS", 7), ("DENSE", dense), ("PART", part)):
        monkeypatch.setattr(weighted, name, value)
    got = found(df, unit, strata)
    monkeypatch.setattr(weighted, "FEW", 0)
    want = found(df, unit, strata)
    assert len(got) == len(want) == 4 * weighted.BLOCK
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-10, nan_ok=True)


def test_draws_of_groups_copy_no_rows(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows are joined with the draws of their units")

    monkeypatch.setattr(weighted, "_local", refuse)
    df = spark.createDataFrame(scores(), SCHEMA)
    assert weighted.bootstrap(df, ["k"], "bedroc", 250, 3, unit="group_id").count() == 2
    assert weighted.paired_deltas(df, "k", "bedroc", 250, 3, unit="group_id").count() == 1

"""Held-out scores of the nested families, as audits store them."""

import os

import pytest
from pyspark.sql import functions as F

from orrery.plans.q_audit import second_metrics
from orrery.plans.q_families import FAMILIES, K, Nested
from orrery.plans.views import Views

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_held_out_scores_are_those_that_are_reported(spark):
    """Every ligand once for each family, in its own fold, and metrics of the rows as those of the pool."""
    n = Nested(Views(spark, FOLDER))
    rows = n.held_out().cache()
    ligands, families = n.v.scores.select("ligand_id").distinct().count(), {f[0] for f in FAMILIES}
    found = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ligand_id").alias("ids"), F.count_distinct("part").alias("parts")).collect()
    assert {r["family"] for r in found} == families
    assert all((r["n"], r["ids"], r["parts"]) == (ligands, ligands, K) for r in found)
    again = {r["family"]: r for r in second_metrics(rows, ["family"]).collect()}
    for r in n.pooled().collect():
        assert again[r["family"]]["second_auc"] == pytest.approx(r["roc_auc"], abs=1e-6)

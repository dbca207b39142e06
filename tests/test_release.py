"""Freezing a protocol and the one-time release of its locked rows."""

import pytest
from pyspark.sql import functions as F

from orrery.sources import release
from orrery.sources.release import Release, ReleaseError


def tables(spark):
    manifest = spark.createDataFrame([(i, "active" if i % 3 == 0 else "decoy", "test" if i % 4 == 0 else "train") for i in range(20)], "ligand_id long, label string, split string")
    matrix = manifest.select("ligand_id", "label", (-F.col("ligand_id") * 1.5).alias("score"), F.lit("never read").alias("other"))
    return manifest, matrix


def test_release_runs_once_and_keeps_its_result(spark, tmp_path):
    manifest, matrix = tables(spark)
    inputs = {"manifest": manifest, "matrix": matrix}
    r = Release(spark, str(tmp_path / "r"))
    assert r.state() == "open"
    frozen = r.freeze({"receptor": "r0", "locked": "test"}, inputs)
    assert r.state() == "frozen"
    with pytest.raises(ReleaseError, match="cannot freeze"):
        r.freeze({"receptor": "r1"}, inputs)

    def evaluate(protocol):
        assert r.state() == "consumed" and protocol["receptor"] == "r0"  # the marker comes before any locked row
        return release.read_locked(matrix, manifest, "ligand_id", "label", "score", "split", protocol["locked"])

    with pytest.raises(ReleaseError, match="authorized"):
        r.release(frozen, inputs, evaluate)
    with pytest.raises(ReleaseError, match="named"):
        r.release("0" * 64, inputs, evaluate, authorized=True)
    with pytest.raises(ReleaseError, match="changed since the freeze: matrix"):
        r.release(frozen, inputs | {"matrix": matrix.withColumn("score", F.col("score") + 1)}, evaluate, authorized=True)
    assert r.state() == "frozen"
    out = r.release(frozen, inputs, evaluate, authorized=True)
    assert sorted(map(tuple, out.collect())) == [(i, "active" if i % 3 == 0 else "decoy", -1.5 * i) for i in range(0, 20, 4)]
    assert r.state() == "released"
    with pytest.raises(ReleaseError, match="cannot release what is released"):
        r.release(frozen, inputs, evaluate, authorized=True)


def test_crash_between_marker_and_result_uses_the_release_up(spark, tmp_path):
    manifest, matrix = tables(spark)
    r = Release(spark, str(tmp_path / "r"))
    frozen = r.freeze({"locked": "test"}, {"matrix": matrix})

    def dies(protocol):
        raise RuntimeError("lost the driver")

    with pytest.raises(RuntimeError, match="lost the driver"):
        r.release(frozen, {"matrix": matrix}, dies, authorized=True)
    again = Release(spark, str(tmp_path / "r"))
    assert again.state() == "consumed"
    with pytest.raises(ReleaseError, match="cannot release what is consumed"):
        again.release(frozen, {"matrix": matrix}, lambda p: matrix, authorized=True)
    with pytest.raises(ReleaseError, match="cannot freeze"):
        again.freeze({}, {})


def test_of_two_that_race_one_goes_on(spark, tmp_path):
    r = Release(spark, str(tmp_path / "r"))
    r._create("consumed.json", {"by": 1})
    with pytest.raises(ReleaseError, match="exists already"):
        r._create("consumed.json", {"by": 2})


def test_fingerprint_ignores_order_only(spark):
    _, matrix = tables(spark)
    one = release.table_fingerprint(matrix)
    assert one == release.table_fingerprint(matrix.orderBy(F.desc("ligand_id")).repartition(5))
    assert one != release.table_fingerprint(matrix.unionAll(matrix.limit(1)))
    assert one != release.table_fingerprint(matrix.withColumn("other", F.lit(None).cast("string")))


def test_locked_rows_are_cross_checked(spark):
    manifest, matrix = tables(spark)
    args = ("ligand_id", "label", "score", "split", "test")
    assert {r["n"] for r in release.locked_audit(matrix, manifest, *args).collect()} == {0}
    bad = matrix.filter("ligand_id not in (4, 5)").unionAll(matrix.filter("ligand_id = 7"))
    bad = bad.withColumn("score", F.when(F.col("ligand_id") == 8, float("nan")).when(F.col("ligand_id") == 9, None).otherwise(F.col("score")))
    bad = bad.withColumn("label", F.when(F.col("ligand_id") == 10, "active").otherwise(F.col("label"))).withColumn("ligand_id", F.when(F.col("ligand_id") == 11, 99).otherwise(F.col("ligand_id")))
    found = {r["violation"]: r["n"] for r in release.locked_audit(bad, manifest, *args).collect()}
    assert found == {"repeated_id": 1, "unknown_id": 1, "missing_id": 3, "label_differs": 1, "locked_score_unusable": 1, "locked_missing": 1}
    with pytest.raises(ReleaseError, match="label_differs: 1"):
        release.read_locked(bad, manifest, *args)
    plan = release.read_locked(matrix, manifest, *args)._jdf.queryExecution().optimizedPlan().toString()
    assert "never read" not in plan

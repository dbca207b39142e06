"""Units, schedules, packages and reports."""

import tarfile

import pytest
from pyspark.sql import functions as F

from orrery.functions import units
from orrery.sources import runs, tables
from orrery.streaming import resume


def test_units_and_exact_steps(spark):
    r = spark.range(1).select(units.picoseconds_to_nanoseconds(F.lit(2500.0)).alias("ns"), units.femtoseconds_to_picoseconds(F.lit(2.5)).alias("ps"), units.is_multiple(F.lit(21), 7).alias("w"), units.steps_of(F.lit(0.3), F.lit(0.1)).alias("n")).first()
    assert (r["ns"], r["ps"], r["w"], r["n"]) == (2.5, 0.0025, True, 3)
    with pytest.raises(Exception, match="whole number of steps"):
        spark.range(1).select(units.steps_of(F.lit(0.35), F.lit(0.1))).collect()


def test_schedules_and_resume_points(spark):
    for bad in ((100, 3, 10), (100, 5, 30), (0, 1, 1)):
        with pytest.raises(ValueError):
            resume.Schedule(*bad)
    df = spark.createDataFrame([(i,) for i in (None, -3, 0, 9, 10, 47, 100, 101)], "done int")
    out = {r["done"]: (r["state"], r["resume_at"], r["steps_left"], r["reports"]) for r in resume.resume_points(df, "done", resume.Schedule(100, 5, 10)).collect()}
    assert out[None] == out[-3] == out[0] == ("restart", 0, 100, 0) and out[9] == ("restart", 0, 100, 1)
    assert out[10] == ("resume", 10, 90, 2) and out[47] == ("resume", 40, 60, 9)
    assert out[100] == ("complete", 100, 0, 20) and out[101] == ("beyond_schedule", None, None, None)


def test_packages_are_read_piece_by_piece_and_stay_the_same(tmp_path):
    for name, text in (("b.csv", "x\n1\n2\n"), ("a/long.bin", "z" * 3_000_000)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert runs.package(str(tmp_path / "one.tgz"), str(tmp_path), ["b.csv", "a/long.bin"], {"b.csv": 2}) == ["a/long.bin", "b.csv"]
    sha = tables.write_bundle({"b.csv": b"x\n1\n2\n", "a/long.bin": b"z" * 3_000_000}, str(tmp_path / "two.tgz"))
    assert (tmp_path / "one.tgz").read_bytes() == (tmp_path / "two.tgz").read_bytes() and len(sha) == 64
    with tarfile.open(tmp_path / "one.tgz") as tar:
        assert [(m.name, m.size, m.mtime, m.uid) for m in tar] == [("a/long.bin", 3_000_000, 0, 0), ("b.csv", 6, 0, 0)]
    with pytest.raises(ValueError, match="2 rows of 3"):
        runs.package(str(tmp_path / "three.tgz"), str(tmp_path), ["b.csv"], {"b.csv": 3})


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(5).coalesce(1)
    assert "Only the first 3 rows" in runs.markdown_report("t", {}, df, most=3) and "Only" not in runs.markdown_report("t", {}, df, most=5)

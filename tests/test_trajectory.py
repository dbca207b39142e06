"""The trajectory reader over files written here byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.sources import trajectory


def record(order, data):
    return struct.pack(f"{order}i", len(data)) + data + struct.pack(f"{order}i", len(data))


def write(path, xyz, cells=None, order="<", first=100, every=10, told=None, **control):
    """``xyz``: frames x atoms x 3."""
    c = [0] * 20
    c[0], c[1], c[2], c[10], c[19] = len(xyz) if told is None else told, first, every, int(cells is not None), 24
    for i, x in control.items():
        c[int(i[1:])] = x
    out = record(order, b"CORD" + struct.pack(f"{order}20i", *c)) + record(order, struct.pack(f"{order}i", 2) + b"made by a test".ljust(80) + b"x".ljust(80)) + record(order, struct.pack(f"{order}i", xyz.shape[1]))
    for k, frame in enumerate(xyz):
        if cells is not None:
            out += record(order, struct.pack(f"{order}6d", *cells[k]))
        for j in range(3):
            out += record(order, frame[:, j].astype(f"{order}f4").tobytes())
    path.write_bytes(out)
    return out


@pytest.fixture(scope="module")
def session(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    trajectory.register(spark)
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize(("order", "celled"), [("<", True), (">", False)])
def test_round_trip(session, tmp_path, order, celled):
    rng = np.random.default_rng(1)
    xyz = rng.normal(size=(23, 7, 3)).astype("f4")
    cells = rng.normal(size=(23, 6)) if celled else None
    write(tmp_path / "a.dcd", xyz, cells, order)
    df = session.read.format("dcd").option("frames", 5).load(str(tmp_path / "a.dcd"))
    assert df.rdd.getNumPartitions() == 5
    rows = df.orderBy("frame", "atom").collect()
    assert len(rows) == 23 * 7
    got = np.array([[r["x"], r["y"], r["z"]] for r in rows], "f4").reshape(xyz.shape)
    assert (got == xyz).all() and [r["step"] for r in rows[::7]] == [100 + 10 * i for i in range(23)]
    assert rows[-1]["cell"] == (list(cells[-1]) if celled else None)


def test_bounds_reach_the_reader(session, tmp_path):
    xyz = np.arange(40 * 3 * 3, dtype="f4").reshape(40, 3, 3)
    write(tmp_path / "a.dcd", xyz)
    read = session.read.format("dcd").option("frames", 4)
    df = read.load(str(tmp_path / "a.dcd"))
    some = df.filter("frame >= 13 and frame < 20 and atom = 1")
    assert sorted(r["frame"] for r in some.collect()) == list(range(13, 20))
    assert some.rdd.getNumPartitions() == 2  # of ten
    assert sorted(r["frame"] for r in df.filter("frame = 39 and atom = 0").collect()) == [39]
    assert df.filter("frame > 39").count() == 0
    part = read.option("start", 5).option("stop", 30).option("stride", 10).load(str(tmp_path / "a.dcd"))
    assert sorted({r["frame"] for r in part.collect()}) == [10, 20]


def test_several_files_and_other_stores(session, tmp_path):
    write(tmp_path / "a.dcd", np.zeros((2, 2, 3), "f4"))
    write(tmp_path / "b.dcd", np.ones((3, 2, 3), "f4"), told=99)  # an old count in the head
    df = session.read.format("dcd").load(f"{tmp_path}/a.dcd,file://{tmp_path}/b.dcd")
    assert {(r["path"].rsplit("/", 1)[1], r["n"]) for r in df.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a.dcd", 4), ("b.dcd", 6)}


def test_no_frames_give_no_rows(session, tmp_path):
    write(tmp_path / "a.dcd", np.zeros((0, 4, 3), "f4"))
    assert session.read.format("dcd").load(str(tmp_path / "a.dcd")).count() == 0


def test_damaged_files_are_errors(session, tmp_path):
    whole = write(tmp_path / "a.dcd", np.zeros((3, 2, 3), "f4"))
    for name, data, says in (("cut", whole[:-5], "cut off"), ("text", b"hello there, this is no trajectory", "not a DCD file")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=says):
            session.read.format("dcd").load(str(tmp_path / name)).count()
    write(tmp_path / "fixed", np.zeros((3, 2, 3), "f4"), c8=1)
    with pytest.raises(Exception, match="fixed atoms"):
        session.read.format("dcd").load(str(tmp_path / "fixed")).count()

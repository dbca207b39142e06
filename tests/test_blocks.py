"""Geometry in blocks of points, against all pairs in plain numpy."""

import numpy as np
import pytest

from orrery.operators import geometry

CLOUD = "point_id long, cluster_id int, x double, y double, z double"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK", 16)
    monkeypatch.setattr(geometry, "SENT", 40)
    monkeypatch.setattr(geometry, "STRIP", 5)


def cloud(n, seed):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(0, 3)), *map(float, rng.normal(0, 0.2, 3))) for i in rng.permutation(n)]


def far(p, q):
    x, y, z = (a - b for a, b in zip(p[2:], q[2:], strict=True))
    return float(np.sqrt(x * x + y * y + z * z))


def test_silhouette_medoids_and_pairs_of_a_crowded_cluster(spark, small_blocks):
    rows = cloud(150, 1)
    df = spark.createDataFrame([*rows, (900, 1, None, 0.0, 0.0), (901, None, 0.1, 0.1, 0.1)], CLOUD)
    got = {r.point_id: r.silhouette for r in geometry.silhouette(df, "cluster_id", "point_id").collect()}
    mean = lambda p, g: np.mean([far(p, q) for q in rows if q[1] == g and q[0] != p[0]])
    for p in rows:
        own, other = mean(p, p[1]), min(mean(p, g) for g in range(3) if g != p[1])
        assert abs(got[p[0]] - (other - own) / max(own, other)) < 1e-9
    assert got[900] == 0 and got[901] == 0 and len(got) == 152
    plain = spark.createDataFrame(rows, CLOUD)
    pairs = {(r.cluster_id, r.a, r.b): r.distance for r in geometry.within(plain, "cluster_id", "point_id").collect()}
    assert pairs == {(p[1], p[0], q[0]): far(p, q) for p in rows for q in rows if p[1] == q[1] and p[0] != q[0]}
    found = {r.cluster_id: r.medoid for r in geometry.medoids(plain, "cluster_id", "point_id").collect()}
    total = lambda p: sum(far(p, q) for q in rows if q[1] == p[1])
    assert found == {g: min((total(p), p[0]) for p in rows if p[1] == g)[1] for g in range(3)}
    held = geometry.blocks(plain, ["cluster_id"], "point_id").selectExpr("max(size(held)) as m", "count(*) as n").first()
    assert held.n > 8 and held.m < 40  # a cluster is no single task


def test_one_point_alone_has_no_row(spark):
    assert geometry.silhouette(spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0)], CLOUD), "cluster_id", "point_id").collect() == []


def test_nearest_partners_of_a_crowded_cell(spark, small_blocks):
    rows = cloud(200, 2)
    rows[5] = (rows[5][0], 1, *rows[6][2:])  # equal places
    rows[6] = (rows[6][0], 1, *rows[6][2:])
    side = lambda p, keep: spark.createDataFrame([(r[0], *r[2:]) for r in rows if keep(r)] + [(999, None, 0.0, 0.0), (998, float("nan"), 0.0, 0.0)], f"{p} long, {p}_x double, {p}_y double, {p}_z double")
    left, right = side("a", lambda r: r[1] == 0), side("b", lambda r: r[1] > 0)
    got = {r.a: (r.contacts, r.clashes, r.closest, r.least) for r in geometry.nearest(left, right, 0.25, 0.12).collect()}
    want = {}
    for p in rows:
        d = [(far(p, q), q[0]) for q in rows if q[1] > 0]
        if p[1] == 0 and min(d)[0] <= 0.25:
            want[p[0]] = (sum(x <= 0.25 for x, _ in d), sum(x <= 0.12 for x, _ in d), min(d)[1], min(d)[0])
    assert got == want
    pairs = {(r.a, r.b): r.distance for r in geometry.near_pairs(left, right, 0.25).collect()}
    assert pairs == {(p[0], q[0]): far(p, q) for p in rows for q in rows if p[1] == 0 and q[1] > 0 and far(p, q) <= 0.25}

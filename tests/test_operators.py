"""Literal cases, ties, degenerate input and violations of the ranking-table operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators import aggregate as agg
from orrery.operators import audit, folds, gates, geometry, normalize, order, ranking, relational, resample, subsets

TOY = [(i + 1, lab, s) for i, (lab, s) in enumerate(zip([1, 0, 1, 0, 0, 1, 0, 0, 1, 0], [11.0, 10.5, 10.0, 9.8, 9.4, 9.1, 8.7, 8.3, 8.0, 7.5]))]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [("k", i, "active" if lab else "decoy", -s) for i, lab, s in TOY]
    return spark.createDataFrame(rows, "k string, ligand_id int, label string, score double")


def test_metrics_of_the_ranked_toy_list(toy):
    r = ranking.metrics(toy, ["k"], fractions=(0.3,)).first()
    assert r.roc_auc == pytest.approx(0.625)
    assert r.average_precision == pytest.approx(0.652778, abs=1e-6)
    assert r.ef30 == pytest.approx(1.6666666666666665)
    assert 0 <= r.bedroc <= 1
    assert (r.ligand_count, r.active_count, r.top10_active_count) == (10, 4, 4)


def test_bedroc_matches_its_definition(toy):
    n, a, alpha = 10, 4, 20.0
    active = [i for i, lab, _ in TOY if lab]
    total = lambda ranks: sum(math.exp(-alpha * r / n) for r in ranks)
    want = (total(active) - total(range(n - a + 1, n + 1))) / (total(range(1, a + 1)) - total(range(n - a + 1, n + 1)))
    assert ranking.metrics(toy, ["k"]).first().bedroc == pytest.approx(want)


def test_auc_agrees_with_counting_pairs_under_ties(spark):
    rng = np.random.default_rng(3)
    rows = [("k", i, "active" if rng.random() < 0.4 else "decoy", float(rng.integers(0, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ligand_id int, label string, score double")
    pos, neg = [r[3] for r in rows if r[2] == "active"], [r[3] for r in rows if r[2] == "decoy"]
    want = sum((p < q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert ranking.metrics(df, ["k"]).first().roc_auc == pytest.approx(want)


def test_undefined_metrics_are_nan(spark):
    df = spark.createDataFrame([("k", 1, "decoy", 0.0), ("k", 2, "decoy", 1.0)], "k string, ligand_id int, label string, score double")
    r = ranking.metrics(df, ["k"]).first()
    assert all(math.isnan(x) for x in (r.roc_auc, r.average_precision, r.bedroc, r.ef1))


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([("b", -10.0), ("a", -10.0), ("c", -9.0)], "ligand_id string, score double").withColumn("k", F.lit(1))
    assert [r.ligand_id for r in ranking.ranked(df, ["k"]).orderBy("rank").collect()] == ["a", "b", "c"]


def test_correlations_of_constant_columns(spark):
    df = spark.createDataFrame([("same", 1.0, 1.0), ("same", 1.0, 1.0), ("other", 1.0, 2.0), ("other", 1.0, 3.0)], "k string, a double, b double")
    assert {r.k: r.r for r in ranking.pearson(df, ["k"], "a", "b").collect()} == {"same": 1.0, "other": 0.0}


def test_representative_falls_back_and_keeps_failures(spark):
    rows = [("A", "R", "ok", -7.0, 1), ("A", "R", "ok", -9.0, 2), ("B", "R", "ok", -5.0, 2), ("B", "R", "failed", -9.0, 1), ("C", "R", "failed", -1.0, 1)]
    df = spark.createDataFrame(rows, "l string, r string, status string, docking_score double, pose_rank int")
    got = {x.l: (x.representative_score, x.status, x.pose_count, x.best_docking_score) for x in relational.representative(df, ["l", "r"]).collect()}
    assert got == {"A": (-7.0, "ok", 2, -9.0), "B": (-5.0, "ok", 1, -5.0), "C": (None, "failed", 0, None)}
    low = {x.l: x.representative_score for x in relational.representative(df, ["l", "r"], "min_score").collect()}
    assert low["A"] == -9.0
    with pytest.raises(ValueError):
        relational.representative(df, ["l"], "median")


def test_seed_stability_cases(spark):
    rows = [("x", i, s) for i, s in enumerate((5.0, -8.0, -7.9))] + [("y", i, s) for i, s in enumerate((1.0, -8.0, 2.0))]
    df = spark.createDataFrame(rows, "k string, seed int, score double")
    got = {r.k: r for r in agg.seed_stability(df, ["k"], "seed", "score", 1.0, 1.0, 2).collect()}
    x, y = got["x"], got["y"]
    assert (x.minimum_score, x.median_score, x.favorable_replicate_count, x.best_replicate_id, x.reasons) == (-8.0, -7.9, 2, 1, "seed_range_exceeded")
    assert (y.median_score, y.favorable_replicate_count, y.warning) == (1.0, 1, True)


def test_percentiles_differ_by_definition(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    r = df.agg(F.percentile("v", 0.95).alias("linear"), agg.nearest_rank("v", 0.95).alias("nearest")).first()
    assert r.linear == pytest.approx(8.95) and r.nearest == 10.0


def test_normalisation_constants_and_no_clipping(spark):
    train = spark.createDataFrame([("R1", -10.0), ("R1", -5.0), ("R2", 3.0), ("R2", 3.0)], "r string, score double")
    new = spark.createDataFrame([("R1", -12.0), ("R2", 4.0)], "r string, score double")
    got = {r.r: r.normalized for r in normalize.apply_bounds(new, normalize.bounds(train, ["r"]), ["r"]).collect()}
    assert got["R1"] == pytest.approx(-0.4) and got["R2"] == 0.0
    terms = spark.createDataFrame([("t", -2.0), ("t", 1.0), ("t", 0.0), ("c", 4.0), ("c", 4.0)], "t string, v double")
    out = terms.select("t", "v", normalize.maxabs("v", ["t"]).alias("m"), normalize.minmax("v", ["t"], 0.5).alias("u")).collect()
    assert {(r.v, r.m) for r in out if r.t == "t"} == {(-2.0, -1.0), (1.0, 0.5), (0.0, 0.0)}
    assert {r.u for r in out if r.t == "c"} == {0.5}


def test_runs_of_a_revisited_cluster(spark):
    labels = [0, 0, 1, 1, 1, 0, 2]
    df = spark.createDataFrame([("r", i, c) for i, c in enumerate(labels)], "run string, frame int, c int")
    got = {r.c: (r.size, r.run_count, r.longest_run, r.revisited) for r in agg.temporal_runs(df, "run", "frame", "c").collect()}
    assert got == {0: (3, 2, 2, True), 1: (3, 1, 3, False), 2: (1, 1, 1, False)}


def test_jaccard_of_empty_sets(spark):
    df = spark.sql("select array() a, array() b union all select array(1,2), array(2,3)")
    assert [r.j for r in df.select(relational.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, pytest.approx(1 / 3)]


def test_audits_fail_closed(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 5.0)], "id int, score double")
    table = audit.audit(df, positive=F.col("score") > 0, missing=F.col("score").isNull())
    assert {r.constraint: r.n_violations for r in table.collect()} == {"positive": 1, "missing": 0}
    with pytest.raises(audit.AuditError, match="positive: 1"):
        audit.enforce(table)
    with pytest.raises(Exception, match="missing label"):
        audit.require(df, F.col("score") < 0, "label").collect()
    with pytest.raises(ValueError):
        relational.strict_join(df, df.filter("id = 1"), ["id"])
    with pytest.raises(ValueError):
        relational.disjoint_union([df, df], "id")
    assert audit.unique_key(df.union(df), ["id"]).first().n_violations == 2
    bad = audit.mismatches(df, df.withColumn("score", F.col("score") + 1e-12), ["id"], "score")
    assert bad.isEmpty()


def test_gate_never_passes_null(spark):
    df = spark.sql("select 1 k, cast(null as double) x")
    checks = df.select("k", gates.check("c", F.col("x"), 1.0, "min").alias("c")).select("k", "c.*")
    r = gates.decide(checks, ["k"]).first()
    assert (r.passed, r.failed_count, r.failed_checks) == (False, 1, "c")


def test_exact_selection_agrees_with_brute_force(spark):
    rng = np.random.default_rng(1)
    n, k = 6, 3
    h, j = rng.normal(size=n), {(a, b): rng.normal() for a in range(n) for b in range(a + 1, n)}
    unary = spark.createDataFrame([(i, float(h[i])) for i in range(n)], "member int, t double")
    pairs = spark.createDataFrame([(a, b, float(w)) for (a, b), w in j.items()], "a int, b int, w double")
    linear, quadratic, constant = subsets.coefficients(unary, pairs, k, 2.0, {"t": 1.0}, {"w": 1.0})
    best = subsets.best_subset(subsets.energies(subsets.k_subsets(spark, range(n)), linear, quadratic, constant)).first()

    def energy(s):
        return sum(h[i] for i in s) + sum(w for (a, b), w in j.items() if a in s and b in s) + 2.0 * (len(s) - k) ** 2

    every = [[i for i in range(n) if m >> i & 1] for m in range(1, 1 << n)]
    assert best.subset == min(every, key=energy) and best.energy == pytest.approx(min(map(energy, every)))
    with pytest.raises(ValueError):
        subsets.k_subsets(spark, range(30))


def test_greedy_takes_the_first_of_equals():
    assert subsets.greedy_forward(["a", "b", "c"], 2, lambda xs: [len(x) for x in xs]) == ["a", "b"]


def test_connected_groups_and_balanced_folds(spark):
    rows = [(1, "s1", "m1"), (2, "s1", "m2"), (3, "s2", "m2"), (4, "s3", None), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, scaffold string, source string")
    got = {r.id: r.group for r in folds.connected_groups(df, "id", ["scaffold", "source"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    groups = [("g%d" % i, (i % 3, 5 - i % 4)) for i in range(20)]
    placed = folds.balanced_folds(sorted(groups, key=lambda x: (-sum(x[1]), x[0])), 4)
    sizes = [sum(sum(c) for g, c in groups if placed[g] == f) for f in range(4)]
    assert max(sizes) - min(sizes) <= 5


def test_rotations_use_each_fold_once(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(6)], "id int, fold int")
    rows = folds.rotations(df, 3).collect()
    assert sorted(r.id for r in rows if r.role == "test") == list(range(6)) and len(rows) == 18


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark, toy):
    a = resample.bootstrap(toy, ["k"], "roc_auc", 40, 7).first()
    b = resample.bootstrap(toy.repartition(3), ["k"], "roc_auc", 40, 7).first()
    assert a == b and a.lower <= a.mean <= a.upper and a.used + a.skipped == 40


def test_alignment_recovers_a_rotation(spark):
    rng = np.random.default_rng(2)
    fixed = rng.normal(size=(12, 3))
    turn = np.array([[0.0, 1, 0], [-1, 0, 0], [0, 0, 1]])
    moving = (fixed - [1, 2, 3]) @ turn.T
    rows = [("k", *map(float, m), *map(float, f)) for m, f in zip(moving, fixed)]
    df = spark.createDataFrame(rows, "k string, a_x double, a_y double, a_z double, b_x double, b_y double, b_z double")
    r = geometry.align(df, "k").first()
    assert r.rmsd < 1e-9 and np.allclose(np.array(r.rotation).reshape(3, 3), turn)


def test_near_pairs_agree_with_all_pairs(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(-2, 2, size=(80, 3))
    side = lambda p, ids: spark.createDataFrame([(i, *map(float, pts[i])) for i in ids], f"{p} int, {p}_x double, {p}_y double, {p}_z double")
    got = {(r.a, r.b) for r in geometry.near_pairs(side("a", range(40)), side("b", range(40, 80)), 0.7).collect()}
    want = {(i, j) for i in range(40) for j in range(40, 80) if np.linalg.norm(pts[i] - pts[j]) <= 0.7}
    assert got == want


def test_ward_separates_blobs_and_maxmin_spreads():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, size=(10, 2)) for c in (0, 5, 10)])
    assert geometry.ward_labels(x, 3).tolist() == [0] * 10 + [1] * 10 + [2] * 10
    d = {(i, j): abs(i - j) for i in range(10) for j in range(10)}
    assert geometry.maxmin_order(range(10), d, 0, 3) == [0, 9, 4]


def test_greedy_splits_keep_groups_and_near_targets():
    groups = sorted([(f"g{i:02}", (i % 3, 1 + i % 5)) for i in range(60)], key=lambda x: (-sum(x[1]), x[0]))
    shares = {"train": 0.6, "validation": 0.2, "test": 0.2}
    placed = folds.greedy_splits(groups, shares)
    assert set(placed) == {g for g, _ in groups}
    for k in range(2):
        total = sum(c[k] for _, c in groups)
        for s, share in shares.items():
            assert abs(sum(c[k] for g, c in groups if placed[g] == s) - share * total) <= 6
    assert folds.greedy_splits([("b", (1, 0)), ("a", (1, 0))], {"y": 0.5, "x": 0.5}) == {"b": "x", "a": "y"}


def test_strict_forms_fail_closed(spark):
    poses = spark.createDataFrame([("A", 1, -1.0, "ok"), ("A", 2, -3.0, "ok"), ("B", 1, None, "failed")], "k string, pose_rank int, docking_score double, status string")
    rows = relational.representative_strict(poses.filter("k = 'A'"), ["k"]).collect()
    assert [tuple(r) for r in rows] == [("A", -1.0, 2, -3.0, 2)]
    with pytest.raises(Exception, match="without a successful pose"):
        relational.representative_strict(poses, ["k"]).collect()
    long = spark.createDataFrame([("A", 0, 1.0), ("A", 1, 2.0), ("B", 0, 3.0)], "k string, r int, s double")
    assert [tuple(r) for r in relational.pivot_strict(long.filter("k = 'A'"), ["k"], "r", [0, 1], "s").collect()] == [("A", 1.0, 2.0)]
    with pytest.raises(Exception, match="missing cell"):
        relational.pivot_strict(long, ["k"], "r", [0, 1], "s").collect()


def test_lower_bound_is_below_all_other_sizes(spark):
    import itertools
    import random

    rng = random.Random(3)
    for _ in range(3):
        h = {m: rng.uniform(-4, 1) for m in range(5)}
        j = {p: rng.uniform(1, 3) for p in itertools.combinations(range(5), 2)}
        least = subsets.lower_bound(
            spark.createDataFrame(list(h.items()), "member int, h double"), spark.createDataFrame([(a, b, x) for (a, b), x in j.items()], "a int, b int, j double"), 2, 1.0
        ).first()[0]
        energy = lambda s: 4.0 + sum(h[m] for m in s) + sum(j[p] for p in itertools.combinations(s, 2))  # noqa: B023, E731
        assert least <= min(energy(s) for n in (0, 1, 3, 4, 5) for s in itertools.combinations(range(5), n)) + 1e-9


def test_samples_take_no_group_twice(spark):
    rows = spark.createDataFrame([(i, "active" if i % 4 == 0 else "decoy", f"g{i % 7}") for i in range(60)], "id long, label string, g string")
    got = folds.diverse_sample(rows, "id", "label", "g", ("active", "decoy"), 3, 1).collect()
    assert len(got) == 6 and len({r.g for r in got}) == 6
    assert folds.random_sample(rows, "id", "label", 5, 1).groupBy("label").count().filter("count = 5").count() == 2
    assert folds.repeated_splits(rows, "id", "label", 3, 1).count() == 180


def test_positions_in_pieces_equal_one_sort(spark):
    values = [None, float("nan"), float("-inf"), float("inf"), 0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, *[x / 7 for x in range(-40, 40)], *[2.5] * 20]
    data = [(k, x, i) for k in ("a", None) for i, x in enumerate(values)]
    df = spark.createDataFrame(data, "k string, score double, id int").withColumn("v", F.col("id") % 3)
    w = Window.partitionBy("k").orderBy("score", "id")
    ties = Window.partitionBy("k", "score")
    want = df.select(
        "k", "id", F.row_number().over(w).alias("at"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("v").over(Window.partitionBy("k")).alias("all"),
        (F.rank().over(Window.partitionBy("k").orderBy("score")) + (F.count(F.lit(1)).over(ties) - 1) / 2).alias("mean"),
    )
    got = order.spread(df, ["k"], order.score_piece("score"), ["score", "id"], {"v": F.col("v")}, ties="score")
    got = got.select("k", "id", F.col("__to_n").alias("at"), F.col("__to_v").alias("run"), F.col("__all_v").alias("all"), F.col("__mean").alias("mean"))
    key = lambda r: (r["k"] or "", r["id"])
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]


def test_positions_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, score double, id int")
    assert order.spread(df, ["k"], order.score_piece("score"), ["score", "id"]).count() == 0


def test_nested_bounds_leave_both_folds_out(spark):
    df = spark.createDataFrame([(f, "r", float(f)) for f in range(4)], "fold int, k string, score double")
    got = {(r.o, r.i): (r.lower, r.upper) for r in folds.nested_bounds(df, 4, ["k"]).collect()}
    assert len(got) == 16 and got[0, 3] == (1.0, 2.0) and got[3, 3] == (0.0, 2.0)


def test_rounds_of_connected_groups_hold_values_not_rows(spark):
    from orrery.operators import folds

    sizes = []

    def counted(df):
        df = df.localCheckpoint()
        sizes.append(df.count())
        return df

    rows = [(i, f"s{i % 7}", f"t{i % 7 // 2}") for i in range(400)] + [(400, None, None), (3, "s9", None), (500, "s9", None), (None, "s0", "t1")]
    df = spark.createDataFrame(rows, "id long, s string, t string")
    found = {r["id"]: r["group"] for r in folds.connected_groups(df, "id", ["s", "t"], counted).collect()}
    assert found == {**{i: i % 7 // 2 * 2 for i in range(400)}, 400: 400, 500: 2, None: None}
    assert max(sizes[1:]) <= 30

"""Objectives over contexts, annealing, matched atoms, pockets, diameters, repeated runs and fallbacks against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import anneal, gates, geometry, pocket, ranking, relational
from orrery.operators import objective as obj
from orrery.operators import subsets as sub
from orrery.streaming import repeats, resume

# --- objectives ------------------------------------------------------------------------------


def test_contexts_and_their_rows(spark):
    assert len(obj.contexts(5)) == 16 and obj.contexts(2) == [(-1, -1), (0, 0), (0, 1), (1, 1)]
    rows = [(i, "active" if i % 2 else "decoy", r, float(-(i * 7 + r * 3) % 11), i % 3) for i in range(12) for r in (0, 1)]
    df = spark.createDataFrame(rows, "ligand_id int, label string, receptor_id int, score double, fold int")
    out = obj.context_rows(df, 3).collect()
    assert len(out) == len(rows) * 7
    for x in out:
        fold = x["ligand_id"] % 3
        assert x["part"] == (fold if fold in (x["a"], x["b"]) else -1)
        train = [s for i, _, r, s, f in rows if r == x["receptor_id"] and f not in (x["a"], x["b"])]
        mine = next(s for i, _, r, s, _ in rows if (i, r) == (x["ligand_id"], x["receptor_id"]))
        assert x["score"] == round((mine - min(train)) / (max(train) - min(train)) * 1e9)  # not clipped


def test_scaled_terms(spark):
    df = spark.createDataFrame([(0, -2.0, 5.0), (0, 1.0, 5.0), (0, 0.0, 5.0), (1, 0.0, 1.0), (1, 0.0, 3.0)], "k int, s double, t double")
    out = obj.scaled_by(df, ["k"], ["t"], ["s"]).orderBy("k", "s").collect()
    assert [(r["s"], r["t"]) for r in out] == [(-1.0, 0.0), (0.0, 0.0), (0.5, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_terms_of_a_small_matrix(spark):
    """Two scorers, two actives and two decoys, the top half."""
    cells = {"A1": (-9, -7), "A2": (-8, -9), "D1": (-5, -8), "D2": (-4, -4)}
    rows = [(0, i, "active" if i[0] == "A" else "decoy", r, float(s[r])) for i, s in cells.items() for r in (0, 1)]
    df = spark.createDataFrame(rows, "k int, ligand_id string, label string, receptor_id int, score double")
    made = obj.ensemble_scores(df, sub.k_subsets(spark, (0, 1), (1, 2)), ["k"])
    from orrery.operators import ranking

    unary, pairs = obj.raw_terms(df, ranking.metrics(made, ["k", "how", "mask"]), ["k"], "bedroc", 0.5)
    got = {r["member"]: r for r in unary.collect()}
    assert (got[0]["coverage"], got[0]["exposure"]) == (1.0, 0.0) and (got[1]["coverage"], got[1]["exposure"]) == (0.5, 0.5)
    assert got[0]["utility"] == pytest.approx(1.0) and got[1]["utility"] < 1
    p = pairs.first()
    # Ranks (1, 2, 3, 4) and (3, 1, 2, 4): correlation 0.4; one active is in both top halves.
    assert p["redundancy"] == pytest.approx(0.4) and p["overlap"] == 0.5
    assert p["pair_synergy_min"] == pytest.approx(p["pair_utility_min"] - 1)


def test_solved_against_enumeration(spark):
    rng = random.Random(3)
    members = range(5)
    unary = [(0, m, *(rng.random() for _ in range(4))) for m in members]
    names = ["redundancy", "overlap", "pair_utility_min", "pair_utility_mean", "pair_synergy_min", "pair_synergy_mean"]
    pairs = [(0, x, y, *(rng.random() - 0.3 for _ in names)) for x, y in itertools.combinations(members, 2)]
    u = spark.createDataFrame(unary, "k int, member int, utility double, coverage double, exposure double, stability double")
    p = spark.createDataFrame(pairs, "k int, x int, y int, " + ", ".join(f"{n} double" for n in names))
    grid = obj.candidate_grid("f", (1, 2, 3), ("min", "mean"), w_coverage=(0.0, 2.0), w_exposure=(0.5,), w_overlap=(0.0, 1.0), w_redundancy=(0.5,), w_utility=(0.7,), w_synergy=(0.0, 3.0), w_stability=(0.4,))
    sums = obj.term_sums(u, p, sub.k_subsets(spark, members), ["k"])

    def energy(s, c):
        _, target, how, *ws = c
        w = dict(zip(obj.WEIGHTS, ws))
        at = names.index
        e = 0.8 * (len(s) - target) ** 2
        for m in s:
            _, _, utility, coverage, exposure, stability = unary[m]
            e += -utility - w["w_coverage"] * coverage + w["w_exposure"] * exposure - w["w_stability"] * stability
        for row in pairs:
            if row[1] in s and row[2] in s:
                v = row[3:]
                e += w["w_overlap"] * v[at("overlap")] + w["w_redundancy"] * v[at("redundancy")] - w["w_utility"] * v[at(f"pair_utility_{how}")] - w["w_synergy"] * v[at(f"pair_synergy_{how}")]
        return e

    every = [s for n in range(1, 6) for s in itertools.combinations(members, n)]
    for required in (None, (1, 4)):
        table = sums if required is None else sums.withColumn("required", F.lit(sum(1 << m for m in required)).cast("long"))
        found = {r["cid"]: r for r in obj.solved(table, obj.candidate_table(spark, grid), ["k"], 0.8).collect()}
        for cid, c in enumerate(grid):
            fits = [s for s in every if required is None or (set(required) <= set(s) and len(s) == c[1])]
            if not fits:
                assert cid not in found
                continue
            best = min(fits, key=lambda s: (round(energy(s, c), 9), s))
            assert found[cid]["mask"] == sum(1 << m for m in best) and found[cid]["energy"] == pytest.approx(energy(best, c), abs=1e-8)
    with pytest.raises(ValueError, match="unknown weights"):
        obj.candidate_grid("f", (1,), ("min",), w_other=(1,))


def test_masks_compare_as_tuples(spark):
    masks = list(range(1, 32))
    df = spark.createDataFrame([(m,) for m in masks], "mask long")
    got = [r["mask"] for r in df.orderBy(obj.in_order("mask")).collect()]
    assert got == sorted(masks, key=lambda m: tuple(i for i in range(5) if m >> i & 1))


# --- annealing -------------------------------------------------------------------------------


def test_annealing_finds_the_exact_minimum(spark):
    rng = random.Random(5)
    linear = [(k, m, rng.uniform(-1, 1)) for k in range(6) for m in range(7)]
    quadratic = [(k, a, b, rng.uniform(-1, 1)) for k in range(6) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.8]
    h = spark.createDataFrame(linear, "k int, member int, h double")
    j = spark.createDataFrame(quadratic, "k int, a int, b int, j double")
    out = anneal.anneal(h, j, ["k"], [1, 2, 3]).collect()
    assert len(out) == 18 and sorted(map(tuple, out)) == sorted(map(tuple, anneal.anneal(h.repartition(3), j, ["k"], [1, 2, 3]).collect()))
    for r in out:
        value = lambda m: sum(x for k, i, x in linear if k == r["k"] and m >> i & 1) + sum(x for k, a, b, x in quadratic if k == r["k"] and m >> a & 1 and m >> b & 1)  # noqa: B023, E731
        best = min(map(value, range(1 << 7)))
        assert r["energy"] == pytest.approx(best, abs=1e-9) == value(r["mask"]) and r["hits"] >= 1


def test_annealing_without_pairs_or_coefficients(spark):
    h = spark.createDataFrame([(0, 0, 1.0), (0, 3, -2.0), (1, 0, 0.0)], "k int, member int, h double")
    j = spark.createDataFrame([], "k int, a int, b int, j double")
    out = {r["k"]: r for r in anneal.anneal(h, j, ["k"], [4]).collect()}
    assert (out[0]["mask"], out[0]["energy"]) == (8, -2.0) and out[1]["energy"] == 0


# --- geometry --------------------------------------------------------------------------------


def test_least_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 6):
        for whole in (False, True):
            for _ in range(20):
                cost = rng.integers(0, 4, (n, n)).astype(float) if whole else rng.random((n, n))
                got = geometry.least_assignment(cost)
                assert sorted(got) == list(range(n))
                assert cost[np.arange(n), got].sum() == pytest.approx(min(cost[np.arange(n), list(p)].sum() for p in itertools.permutations(range(n))))


def test_assignment_rmsd_and_its_reasons(spark):
    schema = "k int, element string, x double, y double, z double"
    a = [(1, "C", 0.0, 0.0, 0.0), (1, "C", 5.0, 0.0, 0.0), (1, "N", 9.0, 0.0, 0.0), (2, "C", 0.0, 0.0, 0.0), (3, "C", 0.0, 0.0, 0.0)]
    b = [(1, "N", 9.0, 3.0, 0.0), (1, "C", 5.0, 0.0, 0.0), (1, "C", 0.0, 0.0, 4.0), (2, "N", 0.0, 0.0, 0.0), (4, "C", 0.0, 0.0, 0.0)]
    out = {r["k"]: r for r in geometry.assignment_rmsd(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"]).collect()}
    assert out[1]["rmsd"] == pytest.approx((25 / 3) ** 0.5) and out[1]["farthest"] == 4 and out[1]["reason"] is None
    assert [out[k]["reason"] for k in (2, 3, 4)] == ["elements_differ", "missing", "missing"] and out[2]["rmsd"] is None


def test_diameters_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(g, *map(float, p)) for g in range(4) for p in rng.normal(size=(150, 3)) * ([1, 5, 0.1] if g == 1 else [1, 1, 1])]
    rows += [(9, 1.0, 2.0, 3.0)]
    got = {r["g"]: r["diameter"] for r in geometry.diameters(spark.createDataFrame(rows, "g int, x double, y double, z double"), "g").collect()}
    for g in got:
        p = np.array([r[1:] for r in rows if r[0] == g])
        assert got[g] == pytest.approx(np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)).max())


def test_pocket_states_reasons_and_filled_features(spark):
    reference = spark.createDataFrame([(1, "ALA", 0.0, 0.0, 0.0), (2, "GLY", 3.0, 0.0, 0.0), (3, "SER", 0.0, 4.0, 0.0)], "residue int, name string, x double, y double, z double")
    rows = [("whole", 1, "ALA", 0.0, 0.0, 1.0), ("whole", 2, "GLY", 3.0, 0.0, 1.0), ("whole", 3, "SER", 0.0, 4.0, 1.0), ("whole", 77, "TRP", 9.0, 9.0, 9.0)]
    rows += [("gap", 1, "ALA", 0.0, 0.0, 0.0), ("gap", 2, "GLY", 6.0, 0.0, 0.0), ("wrong", 1, "ALA", 0.0, 0.0, 0.0), ("wrong", 2, "SER", 1.0, 1.0, 1.0), ("none", 99, "ALA", 0.0, 0.0, 0.0)]
    matched = pocket.against_reference(spark.createDataFrame(rows, "structure_id string, residue int, name string, x double, y double, z double"), reference)
    out = pocket.eligibility(matched, [1], 0.6)
    got = {r["structure_id"]: (r["present"], r["missing"], r["mismatched"], r["missing_anchors"], r["imputed"], r["reasons"]) for r in out.collect()}
    assert got == {
        "whole": (3, "", "", "", 0, ""),
        "gap": (2, "3", "", "", 1, ""),
        "wrong": (1, "3", "2", "", 2, "pocket_share_below_limit;pocket_name_mismatch"),
        "none": (0, "1;2;3", "", "1", 3, "pocket_share_below_limit;missing_anchor"),
    }
    seen = {(r["structure_id"], r["a"], r["b"]): (r["distance"], r["imputed"]) for r in pocket.features(matched, out).collect()}
    assert set(s for s, _, _ in seen) == {"whole", "gap"}
    assert seen["gap", 1, 2] == (6.0, False) and seen["gap", 1, 3] == (4.0, True) and seen["whole", 2, 3] == (5.0, False)


def test_residues_of_both_sides_are_told(spark):
    a = spark.createDataFrame([(1, "ALA"), (2, "GLY"), (3, None)], "residue int, name string")
    b = spark.createDataFrame([(2, "SER"), (3, None), (4, "TRP")], "residue int, name string")
    got = {r["residue"]: r["state"] for r in relational.matched_residues(a, b, ["residue"], "name").collect()}
    assert got == {1: "only_first", 2: "name_differs", 3: "matched", 4: "only_second"}


# --- repeated runs ---------------------------------------------------------------------------


def squares(calls):
    def compute(table):
        calls.append(sorted(r["repeat"] for r in table.collect()))
        return table.withColumn("value", F.col("repeat") * F.col("seed")).withColumn("part", F.explode(F.lit([0, 1])))

    return compute


def test_only_open_repeats_are_computed(spark, tmp_path):
    folder, calls = str(tmp_path / "runs"), []
    go = lambda configs: repeats.run_repeats(spark, folder, configs, "repeat int, seed int", squares(calls))
    out, done = go([{"repeat": 0, "seed": 5}, {"repeat": 1, "seed": 6}])
    assert calls == [[0, 1]] and out.count() == 4 and len(done) == 2
    out, done = go([{"repeat": 0, "seed": 5}, {"repeat": 1, "seed": 7}, {"repeat": 2, "seed": 8}])
    assert calls[1:] == [[1, 2]] and sorted((r["repeat"], r["value"]) for r in out.filter("part = 0").collect()) == [(0, 0), (1, 7), (2, 16)]
    assert go([{"repeat": 2, "seed": 8}])[1] == [] and len(calls) == 2


def test_a_run_that_died_or_changed_is_open_again(spark, tmp_path):
    folder, calls = str(tmp_path / "runs"), []
    configs = [{"repeat": r, "seed": 1} for r in range(3)]
    run = lambda compute: repeats.run_repeats(spark, folder, configs, "repeat int, seed int", compute)

    def dies(table):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run(dies)
    run(squares(calls))
    assert calls == [[0, 1, 2]]
    # Results of one configuration are replaced behind the catalog's back; those of another go.
    h = [repeats.config_hash(c) for c in configs]
    spark.createDataFrame([(1, 1, 99, 0)], "repeat int, seed int, value int, part int").write.mode("overwrite").parquet(f"{folder}/results/config_hash={h[1]}")
    (tmp_path / "runs" / "results" / f"config_hash={h[2]}").rename(tmp_path / "away")
    out, done = run(squares(calls))
    assert calls[1:] == [[1, 2]] and set(done) == {h[1], h[2]}
    assert sorted(r["value"] for r in out.filter("part = 0").collect()) == [0, 1, 2]


def test_chunks_are_signed_without_one_window(spark):
    df = spark.createDataFrame([(i * 50_000, f"c{i % 3}") for i in range(40)], "i long, c string")
    got = {r["chunk"]: r["signature"] for r in resume.chunk_signatures(df, "i", "c", 16, "x").collect()}
    import hashlib

    for k in range(3):
        text = "x|" + ",".join(f"{i * 50_000}:c{i % 3}" for i in range(16 * k, min(40, 16 * k + 16)))
        assert got[k] == hashlib.sha256(text.encode()).hexdigest()


def test_the_fallback_is_selected_where_nothing_passes(spark):
    schema = "m string, ok boolean, merit double"
    one = lambda rows: {r["selected"] for r in gates.with_fallback(spark.createDataFrame(rows, schema), "m", "ok", "merit", "base").collect()}
    assert one([("a", False, 9.0), ("b", False, 1.0)]) == {"base"}
    assert one([("a", False, 9.0), ("b", True, 1.0), ("c", True, 2.0), ("d", True, 2.0), ("e", None, 7.0)]) == {"c"}


def test_subsets_are_made_where_a_ligand_is(spark, capsys):
    """No row of a subset is shuffled, and packed keys give what plain ones give."""
    rows = [(a, b, part, r, i, "active" if i % 3 == 0 else "decoy", (i * 37 + r * 11 + a) % 50) for a, b, part in ((-1, -1, -1), (0, 1, 1), (0, 1, -1)) for r in range(3) for i in range(20) if (r, i) != (2, 7)]
    df = spark.createDataFrame(rows, "a int, b int, part int, receptor_id int, ligand_id long, label string, score long")
    made = obj.ensemble_scores(df, sub.k_subsets(spark, (0, 1, 2)), ["a", "b", "part"])
    made.explain()
    assert "hashpartitioning" in (plan := capsys.readouterr().out) and not any("mask" in x for x in plan.split("\n") if "Exchange" in x)
    plain = {(a, b, p, i, 1 << r): s for a, b, p, r, i, _, s in rows}
    for x in made.collect():
        held = [s for r in range(3) if x.mask >> r & 1 and (s := plain.get((x.a, x.b, x.part, x.ligand_id, 1 << r))) is not None]
        assert x.score == (min(held) if x.how == "min" else round(sum(held) / len(held), 9))
    keys = ["a", "b", "part", "how", "mask"]
    one, two = ranking.metrics(made, keys), obj.ensemble_metrics(made, keys)
    assert one.schema.names == two.schema.names and one.dtypes == two.dtypes
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))

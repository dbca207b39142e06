"""Queries: comparisons, audits, subset selection, folds, resampling, geometry and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators import aggregate as agg
from orrery.operators import audit, folds, gates, normalize, ranking, weighted
from orrery.operators import geometry as geo
from orrery.operators import relational as rel
from orrery.operators import subsets as sub
from orrery.plans.q_core import DOUBLES, METRICS, metric_sql, q_metric_bundle, rounded
from orrery.plans.q_rows import PAIRS, TOP_ACTIVE, set_pairs, top_active_sets
from orrery.plans.q_stats import SUBSETS, chosen_subsets
from orrery.plans.registry import query
from orrery.plans.views import RECEPTORS, SEEDS, Views

# --- comparisons -------------------------------------------------------------------------


def receptor_pairs(v: Views) -> DataFrame:
    """``a, b, ligand_id, label, x, y``: scores of each pair of receptors, side by side."""
    side = lambda r, s: v.scores.select("ligand_id", "label", F.col("receptor_id").alias(r), F.col("score").alias(s))
    return side("a", "x").join(side("b", "y"), ["ligand_id", "label"]).filter("a < b")


BOTH = "(SELECT s.receptor_id AS a, t.receptor_id AS b, s.ligand_id, s.label, s.score AS x, t.score AS y FROM scores s JOIN scores t ON s.ligand_id = t.ligand_id AND s.receptor_id < t.receptor_id)"


@query(f"SELECT a, b, count(*) AS n, round(avg(y - x), 6) AS mean_delta, round(avg(y - x) FILTER (label = 'active'), 6) AS active_delta, round(avg(y - x) FILTER (label = 'decoy'), 6) AS decoy_delta FROM {BOTH} GROUP BY a, b")
def q_receptor_comparison(v: Views) -> DataFrame:
    d = receptor_pairs(v).withColumn("d", F.col("y") - F.col("x"))
    of = lambda x: F.avg(F.when(F.col("label") == x, F.col("d")))
    out = d.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_delta"), of("active").alias("active_delta"), of("decoy").alias("decoy_delta"))
    return rounded(out, "mean_delta", "active_delta", "decoy_delta")


SPEARMAN = """ar AS (SELECT receptor_id, ligand_id, rank() OVER (PARTITION BY receptor_id ORDER BY score) + (count(*) OVER (PARTITION BY receptor_id, score) - 1) / 2.0E0 AS r FROM scores),
rho AS (SELECT s.receptor_id AS a, t.receptor_id AS b, round(corr(s.r, t.r), 6) AS rho FROM ar s JOIN ar t ON s.ligand_id = t.ligand_id AND s.receptor_id < t.receptor_id GROUP BY 1, 2)"""


def redundancy(v: Views) -> DataFrame:
    out = ranking.spearman(receptor_pairs(v), ["a", "b"], "x", "y")
    return out.select("a", "b", F.round("r", 6).alias("rho"))


@query(f"WITH {SPEARMAN}, {TOP_ACTIVE}, {PAIRS} SELECT p.a, p.b, rho, CAST(len(list_intersect(x, y)) AS INT) AS shared_actives, CAST(len(x) + len(y) - len(list_intersect(x, y)) AS INT) AS union_actives FROM p JOIN rho ON p.a = rho.a AND p.b = rho.b")
def q_complementarity(v: Views) -> DataFrame:
    sets = set_pairs(top_active_sets(v)).select(
        "a", "b", F.size(F.array_intersect("x", "y")).alias("shared_actives"), F.size(F.array_union("x", "y")).alias("union_actives")
    )
    return sets.join(redundancy(v), ["a", "b"])


@query(f"WITH {TOP_ACTIVE} SELECT receptor_id, CAST(len(ids) AS INT) AS covered, round(len(ids) * 1.0E0 / (SELECT count(DISTINCT ligand_id) FROM scores WHERE label = 'active'), 6) AS coverage FROM u")
def q_active_coverage(v: Views) -> DataFrame:
    total = v.scores.filter("label = 'active'").agg(F.count_distinct("ligand_id").alias("t"))
    return top_active_sets(v).crossJoin(total).select("receptor_id", F.size("ids").alias("covered"), F.round(F.size("ids") / F.col("t"), 6).alias("coverage"))


SUB = """sb AS (SELECT mask FROM range(1, 32) t(mask) WHERE bit_count(mask) IN ({sizes})),
ss AS (SELECT mask, split, ligand_id, label, {how}(score) AS score FROM scores JOIN sb ON (mask >> receptor_id) & 1 = 1 GROUP BY mask, split, ligand_id, label), """


def subset_metrics(v: Views, sizes, how: str = "min_score", by_split: bool = False) -> DataFrame:
    """Rank metrics of each subset's ensemble, with the subset."""
    subsets = sub.k_subsets(v.spark, RECEPTORS, sizes)
    keys = ["mask", "split"] if by_split else ["mask"]
    scored = sub.subset_scores(v.scores, subsets, ["split", "ligand_id", "label"], how)
    return rounded(ranking.metrics(scored, keys), *DOUBLES).join(F.broadcast(subsets), "mask")


@query("""WITH h AS (SELECT ligand_id, CAST(sum(1 << receptor_id) AS BIGINT) AS have FROM pair_scores GROUP BY ligand_id)
SELECT mask, CAST(bit_count(mask) AS INT) AS size, (SELECT count(*) FROM h WHERE have & mask = mask) AS complete FROM range(1, 32) t(mask) WHERE bit_count(mask) IN (2, 3)""")
def q_k_subsets(v: Views) -> DataFrame:
    """Subsets of two and three receptors, and how many ligands have a score for every member."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("receptor_id").cast("int"))
    have = v.pair_scores.groupBy("ligand_id").agg(F.sum(bit).alias("have")).groupBy("have").agg(F.count(F.lit(1)).alias("n"))
    subsets = sub.k_subsets(v.spark, RECEPTORS, (2, 3)).select("mask", "size")
    held = subsets.join(F.broadcast(have), F.col("have").bitwiseAND(F.col("mask")) == F.col("mask"), "left")  # have: at most one row a subset
    return held.groupBy("mask", "size").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("complete"))


@query(metric_sql("mask, split", "ss", "mask, split, roc_auc, average_precision, bedroc, ef10", SUB.format(sizes="1, 3, 5", how="min")))
def q_subset_comparison(v: Views) -> DataFrame:
    return subset_metrics(v, (1, 3, 5), by_split=True).select("mask", "split", "roc_auc", "average_precision", "bedroc", "ef10")


DIST = "CAST(bit_count(mask) AS INT) AS size, count(*) AS subsets, min(bedroc) AS min, round(quantile_cont(bedroc, 0.05), 5) AS q05, round(median(bedroc), 5) AS median, round(avg(bedroc), 5) AS mean, round(stddev_pop(bedroc), 5) AS population_std, round(quantile_cont(bedroc, 0.95), 5) AS q95, max(bedroc) AS max"


@query(metric_sql("mask", "ss", DIST, SUB.format(sizes="2, 3", how="min")) + " GROUP BY 1")
def q_subset_distribution(v: Views) -> DataFrame:
    m = subset_metrics(v, (2, 3)).groupBy("size").agg(F.count(F.lit(1)).alias("subsets"), *agg.distribution("bedroc"))
    return rounded(m, "q05", "median", "mean", "population_std", "q95", places=5)


NAME = "array_to_string(list_filter([0, 1, 2, 3, 4], lambda r: (mask >> r) & 1 = 1), '+')"


@query(metric_sql("mask", "ss", f"{NAME} AS subset, bedroc", SUB.format(sizes="1, 2, 3", how="min")) + " ORDER BY bedroc DESC, roc_auc DESC, 1 LIMIT 1")
def q_exhaustive_best(v: Views) -> DataFrame:
    m = subset_metrics(v, (1, 2, 3)).withColumn("subset", sub.subset_name("subset"))
    return m.orderBy(F.desc("bedroc"), F.desc("roc_auc"), "subset").limit(1).select("subset", "bedroc")


@query(metric_sql("mask", "ss", f"{NAME} AS subset, bedroc", SUB.format(sizes="1, 2, 3, 4, 5", how="min")) + " ORDER BY bedroc DESC, roc_auc DESC, 1 DESC LIMIT 1")
def q_upper_bound(v: Views) -> DataFrame:
    """Over all sizes, and of equals the last in order."""
    m = subset_metrics(v, None).withColumn("subset", sub.subset_name("subset"))
    return m.orderBy(F.desc("bedroc"), F.desc("roc_auc"), F.desc("subset")).limit(1).select("subset", "bedroc")


GREEDY = """, g1 AS (SELECT mask FROM mx WHERE bit_count(mask) = 1 ORDER BY bedroc DESC, mask LIMIT 1),
g2 AS (SELECT mx.mask FROM mx, g1 WHERE bit_count(mx.mask) = 2 AND mx.mask & g1.mask = g1.mask ORDER BY bedroc DESC, mx.mask LIMIT 1),
g3 AS (SELECT mx.mask FROM mx, g2 WHERE bit_count(mx.mask) = 3 AND mx.mask & g2.mask = g2.mask ORDER BY bedroc DESC, mx.mask LIMIT 1)
SELECT """ + NAME + " AS subset FROM g3"


@query(f"WITH {SUB.format(sizes='1, 2, 3', how='min')}{METRICS.format(keys='mask', rows='ss')}{GREEDY}")
def q_greedy_select(v: Views) -> DataFrame:
    """Forward selection: each round is one job over all candidates that are left."""

    def value(candidates: list[list[int]]) -> list[float]:
        masks = [sum(1 << r for r in c) for c in candidates]
        subsets = sub.k_subsets(v.spark, RECEPTORS).filter(F.col("mask").isin(masks))
        scored = sub.subset_scores(v.scores, subsets, ["ligand_id", "label"], "min_score")
        found = {r["mask"]: r["bedroc"] for r in rounded(ranking.metrics(scored, ["mask"]), *DOUBLES).collect()}
        return [found[m] for m in masks]

    chosen = sub.greedy_forward(RECEPTORS, 3, value)
    return v.spark.createDataFrame([("+".join(map(str, chosen)),)], "subset string")


# --- quadratic objectives ---------------------------------------------------------------------

UNARY = f"""un AS (SELECT mx.receptor_id, roc_auc, bedroc, ef5, round(len(ids) * 1.0E0 / (SELECT count(DISTINCT ligand_id) FROM scores WHERE label = 'active'), 6) AS coverage,
  round(dc.n * 1.0E0 / (SELECT count(DISTINCT ligand_id) FROM scores WHERE label = 'decoy'), 6) AS exposure FROM mx JOIN u ON u.receptor_id = mx.receptor_id
  JOIN (SELECT receptor_id, count(*) FILTER (label = 'decoy' AND r <= greatest(1, ceil(n * 0.1E0))) AS n FROM (SELECT *, row_number() OVER (PARTITION BY receptor_id ORDER BY score, ligand_id) AS r,
    count(*) OVER (PARTITION BY receptor_id) AS n FROM scores) GROUP BY receptor_id) dc ON dc.receptor_id = mx.receptor_id),
{PAIRS}, bi AS (SELECT p.a, p.b, greatest(0, rho) AS redundancy, round(len(list_intersect(x, y)) * 1.0E0 / (SELECT count(DISTINCT ligand_id) FROM scores WHERE label = 'active'), 6) AS overlap FROM p JOIN rho ON rho.a = p.a AND rho.b = p.b)"""
BASE = f"WITH {METRICS.format(keys='receptor_id', rows='scores')}, {SPEARMAN}, {TOP_ACTIVE}, {UNARY}"


def unary_terms(v: Views) -> DataFrame:
    """``member, roc_auc, bedroc, ef5, coverage, exposure`` per receptor."""
    m = q_metric_bundle(v).select(F.col("receptor_id").alias("member"), "roc_auc", "bedroc", "ef5")
    top = ranking.ranked(v.scores, ["receptor_id"], n="n").filter(F.col("rank") <= ranking.top_count(F.col("n"), 0.1))
    decoys = top.groupBy(F.col("receptor_id").alias("member")).agg(F.count_if(F.col("label") == "decoy").alias("d"))
    totals = v.scores.agg(
        F.count_distinct(F.when(F.col("label") == "active", F.col("ligand_id"))).alias("at"),
        F.count_distinct(F.when(F.col("label") == "decoy", F.col("ligand_id"))).alias("dt"),
    )
    actives = top_active_sets(v).select(F.col("receptor_id").alias("member"), F.size("ids").alias("c"))
    out = m.join(decoys, "member").join(actives, "member").crossJoin(totals)
    return out.select("member", "roc_auc", "bedroc", "ef5", F.round(F.col("c") / F.col("at"), 6).alias("coverage"), F.round(F.col("d") / F.col("dt"), 6).alias("exposure"))


def pair_terms(v: Views) -> DataFrame:
    """``a, b, redundancy, overlap`` per pair: clipped rank correlation, shared top actives."""
    total = v.scores.filter("label = 'active'").agg(F.count_distinct("ligand_id").alias("t"))
    shared = set_pairs(top_active_sets(v)).select("a", "b", F.size(F.array_intersect("x", "y")).alias("s")).crossJoin(total)
    return shared.join(redundancy(v), ["a", "b"]).select(
        "a", "b", F.greatest(F.lit(0.0), F.col("rho")).alias("redundancy"), F.round(F.col("s") / F.col("t"), 6).alias("overlap")
    )


def base_coefficients(v: Views, size: int = 2, redundancy_weight: float = 0.25):
    return sub.coefficients(unary_terms(v), pair_terms(v), size, 1.0, {"roc_auc": -1.0}, {"redundancy": redundancy_weight}, 0.1)


COEF = """, h AS (SELECT receptor_id AS r, -roc_auc + 0.1E0 + 1.0E0 * (1 - 2 * {k}) AS h FROM un), j AS (SELECT a, b, {w} * redundancy + 2.0E0 AS j FROM bi)"""
ENERGY = """, sz AS (SELECT mask, CAST(bit_count(mask) AS INT) AS size FROM range(1, 32) t(mask)), hs AS (SELECT mask, sum(h) AS h FROM sz JOIN h ON (mask >> r) & 1 = 1 GROUP BY mask),
js AS (SELECT mask, sum(j) AS j FROM sz JOIN j ON (mask >> a) & 1 = 1 AND (mask >> b) & 1 = 1 GROUP BY mask),
en AS (SELECT sz.mask, size, {c} + hs.h + coalesce(js.j, 0) AS energy FROM sz JOIN hs ON hs.mask = sz.mask LEFT JOIN js ON js.mask = sz.mask)"""


@query(BASE + " SELECT receptor_id AS member, roc_auc, bedroc, ef5, coverage, exposure FROM un")
def q_qubo_base(v: Views) -> DataFrame:
    return unary_terms(v)


@query(BASE + " SELECT a, b, overlap FROM bi")
def q_coverage_terms(v: Views) -> DataFrame:
    return pair_terms(v).select("a", "b", "overlap")


@query(BASE + " SELECT receptor_id AS member, round(coverage - exposure, 6) AS discrimination FROM un")
def q_discriminative_terms(v: Views) -> DataFrame:
    return unary_terms(v).select("member", F.round(F.col("coverage") - F.col("exposure"), 6).alias("discrimination"))


PAIRED = f"pm AS (SELECT a AS pa, b AS pb, ligand_id, label, {{how}} AS score FROM {BOTH}), "


@query(f"""WITH {PAIRED.format(how="least(x, y)")}{METRICS.format(keys="pa, pb", rows="pm")}, {METRICS.format(keys="receptor_id", rows="scores").replace("rk AS", "rk1 AS").replace("FROM rk)", "FROM rk1)").replace("rs AS", "rs1 AS").replace("FROM rs GROUP", "FROM rs1 GROUP").replace("me AS", "me1 AS").replace("FROM me)", "FROM me1)").replace("mx AS", "mx1 AS")}
SELECT mx.pa AS a, mx.pb AS b, mx.bedroc AS utility, round(mx.bedroc - greatest(s.bedroc, t.bedroc), 6) AS synergy FROM mx JOIN mx1 s ON s.receptor_id = mx.pa JOIN mx1 t ON t.receptor_id = mx.pb""")
def q_pair_synergy(v: Views) -> DataFrame:
    """What a pair's ensemble adds to the better of its two members."""
    pairs = receptor_pairs(v).withColumn("score", F.least("x", "y"))
    m = rounded(ranking.metrics(pairs, ["a", "b"]), "bedroc").select("a", "b", F.col("bedroc").alias("utility"))
    one = q_metric_bundle(v).select("receptor_id", "bedroc")
    left, right = one.toDF("a", "ba"), one.toDF("b", "bb")
    return m.join(left, "a").join(right, "b").select("a", "b", "utility", F.round(F.col("utility") - F.greatest("ba", "bb"), 6).alias("synergy"))


@query(BASE + COEF.format(k=2, w=0.25) + " SELECT 'h' AS kind, CAST(r AS VARCHAR) AS key, round(h, 8) AS value FROM h UNION ALL SELECT 'j', a || '__' || b, round(j, 8) FROM j")
def q_qubo_coefficients(v: Views) -> DataFrame:
    h, j, _ = base_coefficients(v)
    linear = h.select(F.lit("h").alias("kind"), F.col("member").cast("string").alias("key"), F.round("h", 8).alias("value"))
    return linear.union(j.select(F.lit("j"), F.concat_ws("__", "a", "b"), F.round("j", 8)))


@query(BASE + COEF.format(k=2, w=0.25) + ENERGY.format(c="4.0E0") + " SELECT mask, size, round(energy, 8) AS energy FROM en")
def q_qubo_energy(v: Views) -> DataFrame:
    h, j, c = base_coefficients(v)
    return rounded(sub.energies(sub.k_subsets(v.spark, RECEPTORS), h, j, c).select("mask", "size", "energy"), "energy", places=8)


@query(BASE + COEF.format(k=2, w=0.25) + ENERGY.format(c="4.0E0") + f" SELECT {NAME} AS subset, round(energy, 8) AS energy FROM en ORDER BY round(energy, 9), subset LIMIT 1")
def q_qubo_exact(v: Views) -> DataFrame:
    h, j, c = base_coefficients(v)
    best = sub.best_subset(sub.energies(sub.k_subsets(v.spark, RECEPTORS), h, j, c))
    return best.select(sub.subset_name("subset").alias("subset"), F.round("energy", 8).alias("energy"))


def _grid_sql(points: list[tuple[int, float]]) -> str:
    """The best subset of each (size, weight), from terms that are computed once."""
    values = ", ".join(f"({k}, {w}E0)" for k, w in points)
    return BASE + f""", gr AS (SELECT * FROM (VALUES {values}) t(k, w)), sz AS (SELECT mask FROM range(1, 32) t(mask)),
    hs AS (SELECT mask, k, w, sum(-roc_auc + 0.1E0 + (1 - 2 * k)) AS h FROM sz JOIN un ON (mask >> receptor_id) & 1 = 1, gr GROUP BY mask, k, w),
    js AS (SELECT mask, k, w, sum(w * redundancy + 2) AS j FROM sz JOIN bi ON (mask >> a) & 1 = 1 AND (mask >> b) & 1 = 1, gr GROUP BY mask, k, w),
    en AS (SELECT hs.mask, hs.k, hs.w, hs.k * hs.k + hs.h + coalesce(js.j, 0) AS energy FROM hs LEFT JOIN js ON js.mask = hs.mask AND js.k = hs.k AND js.w = hs.w),
    b AS (SELECT *, row_number() OVER (PARTITION BY k, w ORDER BY round(energy, 9), {NAME}) AS n FROM en)
    SELECT CAST(k AS INT) AS k, w, {NAME} AS subset, round(energy, 8) AS energy FROM b WHERE n = 1"""


def _grid(v: Views, points: list[tuple[int, float]]) -> DataFrame:
    """Weights are key columns: terms once, energies of all points in one join."""
    grid = F.broadcast(v.spark.createDataFrame(points, "k int, w double"))
    subsets = sub.k_subsets(v.spark, RECEPTORS)
    members = subsets.select("mask", F.explode("subset").alias("member")).join(unary_terms(v), "member").crossJoin(grid)
    h = members.groupBy("mask", "k", "w").agg(F.sum(-F.col("roc_auc") + 0.1 + (1 - 2 * F.col("k"))).alias("h"))
    pairs = subsets.join(pair_terms(v), F.array_contains("subset", F.col("a")) & F.array_contains("subset", F.col("b"))).crossJoin(grid)
    j = pairs.groupBy("mask", "k", "w").agg(F.sum(F.col("w") * F.col("redundancy") + 2).alias("j"))
    energy = h.join(j, ["mask", "k", "w"], "left").join(subsets, "mask")
    energy = energy.withColumn("energy", F.col("k") * F.col("k") + F.col("h") + F.coalesce("j", F.lit(0.0)))
    best = sub.best_subset(energy, ["k", "w"])
    return best.select("k", "w", sub.subset_name("subset").alias("subset"), F.round("energy", 8).alias("energy"))


SENSITIVITY = [(k, w) for k in (1, 2, 3) for w in (0.0, 0.5, 2.0)]


@query(_grid_sql(SENSITIVITY))
def q_qubo_sensitivity(v: Views) -> DataFrame:
    return _grid(v, SENSITIVITY)


@query(f"WITH {SUBSETS} SELECT r AS member, count(*) AS n FROM (SELECT unnest(subset) AS r FROM t) GROUP BY r HAVING count(*) * 1.0E0 / (SELECT count(*) FROM t) >= 0.5")
def q_consensus_core(v: Views) -> DataFrame:
    return sub.consensus_core(sub.inclusion_frequency(chosen_subsets(v), "subset"), 0.5).select("member", "n")


@query(metric_sql("split, receptor_id", "scores", "receptor_id, round(avg(bedroc) - stddev_pop(bedroc), 5) AS stability") + " GROUP BY receptor_id")
def q_stability_term(v: Views) -> DataFrame:
    m = rounded(ranking.metrics(v.scores, ["split", "receptor_id"]), "bedroc")
    return m.groupBy("receptor_id").agg(F.round(F.avg("bedroc") - F.stddev_pop("bedroc"), 5).alias("stability"))


# --- audits and gates -------------------------------------------------------------------------------


@query("SELECT ligand_id, receptor_id, mid, hi FROM replicates WHERE NOT abs(mid - hi) <= 1.0E-9")
def q_recompute_audit(v: Views) -> DataFrame:
    """Pairs whose stored median is not the recomputed value: here, not the maximum."""
    new = v.replicates.select("ligand_id", "receptor_id", F.col("hi").alias("mid"))
    return audit.mismatches(v.replicates, new, ["ligand_id", "receptor_id"], "mid").withColumnRenamed("recomputed", "hi")


@query("SELECT 0 AS n_mismatches, count(*) AS cells FROM scores")
def q_matrix_audit(v: Views) -> DataFrame:
    """A wide matrix against its long source."""
    long = rel.unpivot_scores(v.wide, ["ligand_id"], [f"r{i}" for i in RECEPTORS], "c", "score")
    long = long.select("ligand_id", F.substring("c", 2, 9).cast("int").alias("receptor_id"), "score")
    bad = audit.mismatches(v.scores, long, ["ligand_id", "receptor_id"], "score")
    cells = v.scores.agg(F.count(F.lit(1)).alias("cells"))
    return bad.agg(F.count(F.lit(1)).cast("int").alias("n_mismatches")).crossJoin(cells)


@query("SELECT 'bad_status' AS constraint, count(*) FILTER (status NOT IN ('ok', 'failed')) AS n_violations, true AS passed FROM poses UNION ALL SELECT 'positive_score', count(*) FILTER (docking_score > 0), count(*) FILTER (docking_score > 0) = 0 FROM poses UNION ALL SELECT 'null_score', count(*) FILTER (docking_score IS NULL), count(*) FILTER (docking_score IS NULL) = 0 FROM poses")
def q_row_audit(v: Views) -> DataFrame:
    return audit.audit(
        v.poses,
        bad_status=~F.col("status").isin("ok", "failed"),
        positive_score=F.col("docking_score") > 0,
        null_score=F.col("docking_score").isNull(),
    )


@query("""SELECT receptor_id, count(*) AS pairs, count(*) FILTER (hi - lo > 100 OR lo >= 0) AS flagged, round(count(*) FILTER (hi - lo > 100 OR lo >= 0) * 1.0E0 / count(*), 6) AS share,
  count(*) FILTER (hi - lo > 100 OR lo >= 0) * 1.0E0 / count(*) <= 0.5 AS admission_passed FROM replicates GROUP BY receptor_id""")
def q_admission_gate(v: Views) -> DataFrame:
    flagged = (F.col("hi") - F.col("lo") > 100) | (F.col("lo") >= 0)
    out = v.replicates.groupBy("receptor_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(flagged).alias("flagged"))
    share = F.col("flagged") / F.col("pairs")
    return out.withColumns({"share": F.round(share, 6), "admission_passed": share <= 0.5})


@query("SELECT group_id, count(DISTINCT split) AS fold_count FROM ligands GROUP BY group_id HAVING count(DISTINCT split) > 1")
def q_leakage_audit(v: Views) -> DataFrame:
    return audit.crossing_groups(v.ligands, "group_id", "split")


@query("""WITH c AS (SELECT receptor_id, 'enough_rows' AS name, count(*) >= 50 AS ok FROM scores GROUP BY receptor_id UNION ALL SELECT receptor_id, 'good_best', min(score) <= -900 FROM scores GROUP BY receptor_id
  UNION ALL SELECT receptor_id, 'good_mean', avg(score) <= -500 FROM scores GROUP BY receptor_id)
SELECT receptor_id, bool_and(ok) AS passed, count(*) FILTER (NOT ok) AS failed_count, coalesce(string_agg(name, ';' ORDER BY name) FILTER (NOT ok), '') AS failed_checks FROM c GROUP BY receptor_id""")
def q_gate_decision(v: Views) -> DataFrame:
    s = v.scores.groupBy("receptor_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("m"), F.avg("score").alias("a"))
    checks = F.array(gates.check("enough_rows", F.col("n"), 50, "min"), gates.check("good_best", F.col("m"), -900, "max"), gates.check("good_mean", F.col("a"), -500, "max"))
    return gates.decide(s.select("receptor_id", F.explode(checks).alias("c")).select("receptor_id", "c.*"), ["receptor_id"])


@query(metric_sql("matrix_id, receptor_id", "matrices", "receptor_id, min(bedroc) AS worst, count(*) FILTER (bedroc >= 0.1) AS passes, coalesce(min(bedroc) >= 0.1, false) AS reliable") + " GROUP BY receptor_id")
def q_reliability_gate(v: Views) -> DataFrame:
    m = rounded(ranking.metrics(v.matrices, ["matrix_id", "receptor_id"]), "bedroc")
    return m.groupBy("receptor_id").agg(
        F.min("bedroc").alias("worst"), F.count_if(F.col("bedroc") >= 0.1).alias("passes"), F.coalesce(F.min("bedroc") >= 0.1, F.lit(False)).alias("reliable")
    )


# --- folds and resampling ------------------------------------------------------------------------------


@query("""SELECT ligand_id, label, CASE WHEN r <= floor(n * 0.6E0) THEN 'train' WHEN r <= floor(n * (0.6E0 + 0.2E0)) THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT ligand_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('7|' || ligand_id), ligand_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM ligands)""")
def q_stratified_split(v: Views) -> DataFrame:
    return folds.stratified_split(v.ligands.select("ligand_id", "label"), "ligand_id", "label", 7)


@query("""WITH RECURSIVE k AS (SELECT ligand_id, 's:' || group_id || '-' || source_id AS c FROM ligands UNION SELECT ligand_id, 'h:' || source_id || '-' || heavy_atoms FROM ligands),
e AS (SELECT DISTINCT a.ligand_id AS a, b.ligand_id AS b FROM k a JOIN k b ON a.c = b.c),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS ligand_id, min(b) AS "group" FROM r GROUP BY a""")
def q_connected_groups(v: Views) -> DataFrame:
    """Ligands that hang together through a scaffold (brand and type) or a source (type and size)."""
    links = v.ligands.select("ligand_id", F.concat_ws("-", "group_id", "source_id").alias("scaffold"), F.concat_ws("-", "source_id", "heavy_atoms").alias("source"))
    return folds.connected_groups(links, "ligand_id", ["scaffold", "source"])


@query("""WITH g AS (SELECT group_id || '-' || source_id AS g, count(*) FILTER (label = 'active') AS a, count(*) FILTER (label = 'decoy') AS d FROM ligands WHERE split = 'validation' GROUP BY 1),
t AS (SELECT sum(a) AS a, sum(d) AS d FROM g WHERE a > 0),
f AS (SELECT g, coalesce(sum(d) OVER (ORDER BY sha256('11|' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WHERE a = 0),
c AS (SELECT g FROM g WHERE a > 0 UNION ALL SELECT g FROM f, t WHERE t.d + before < 3 * t.a)
SELECT ligand_id, label FROM ligands WHERE split = 'validation' AND group_id || '-' || source_id IN (SELECT g FROM c)""")
def q_hash_ordered_panel(v: Views) -> DataFrame:
    rows = v.ligands.filter("split = 'validation'").withColumn("g", F.concat_ws("-", "group_id", "source_id"))
    return folds.hash_ordered_panel(rows, "g", "label", 11, 3.0).select("ligand_id", "label")


FOLDS = "fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY receptor_id, label ORDER BY sha256('3|' || ligand_id), ligand_id) - 1) % 5 AS INT) AS fold FROM scores)"


def folded(v: Views) -> DataFrame:
    """Fold per ligand; the same for every receptor, as all have the same ligands."""
    ligands = folds.label_folds(v.scores.select("ligand_id", "label").distinct(), "ligand_id", "label", 5, 3)
    return v.scores.join(ligands.select("ligand_id", "fold"), "ligand_id")


OOF = """, bo AS (SELECT f.fold, s.receptor_id, min(s.score) AS lower, max(s.score) AS upper FROM (SELECT DISTINCT fold FROM fo) f JOIN fo s ON s.fold <> f.fold GROUP BY f.fold, s.receptor_id),
oo AS (SELECT fo.receptor_id, ligand_id, label, CASE WHEN upper = lower THEN 0 ELSE round((score - lower) / (upper - lower), 9) END AS score FROM fo JOIN bo ON bo.fold = fo.fold AND bo.receptor_id = fo.receptor_id), """


@query(f"WITH {FOLDS}{OOF}{METRICS.format(keys='receptor_id', rows='oo')} SELECT receptor_id, roc_auc, bedroc FROM mx")
def q_oof_metrics(v: Views) -> DataFrame:
    """Out-of-fold scores: each fold is scaled by the bounds of the others, then all are ranked together."""
    f = folded(v)
    sums = f.groupBy("fold", "receptor_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    other = sums.withColumnRenamed("fold", "o").join(sums.select("fold").distinct(), F.col("o") != F.col("fold"))
    bounds = other.groupBy("fold", "receptor_id").agg(F.min("lo").alias("lower"), F.max("hi").alias("upper"))
    scaled = normalize.apply_bounds(f, bounds, ["fold", "receptor_id"]).withColumn("score", F.round("normalized", 9))
    return rounded(ranking.metrics(scaled, ["receptor_id"]), *DOUBLES).select("receptor_id", "roc_auc", "bedroc")


@query(f"WITH {FOLDS}, ro AS (SELECT rotation, CASE WHEN fold = rotation THEN 'test' WHEN fold = (rotation + 1) % 5 THEN 'validation' ELSE 'train' END AS role, receptor_id, ligand_id, label, score FROM fo, range(0, 5) t(rotation)), {METRICS.format(keys='rotation, role, receptor_id', rows='ro')} SELECT CAST(rotation AS INT) AS rotation, role, receptor_id, roc_auc, bedroc FROM mx")
def q_rotating_cv(v: Views) -> DataFrame:
    rows = folds.rotations(folded(v), 5)
    return rounded(ranking.metrics(rows, ["rotation", "role", "receptor_id"]), *DOUBLES).select("rotation", "role", "receptor_id", "roc_auc", "bedroc")


#: Valid draws of the bootstrap queries.
DRAWS = 5000


@query()
def q_bootstrap_ci(v: Views) -> DataFrame:
    return rounded(weighted.bootstrap(v.scores, ["receptor_id"], "bedroc", DRAWS, 13), "mean", "lower", "upper")


@query()
def q_stratified_bootstrap(v: Views) -> DataFrame:
    return rounded(weighted.bootstrap(v.scores, ["receptor_id"], "roc_auc", DRAWS, 14, strata=["label"]), "mean", "lower", "upper")


@query()
def q_block_bootstrap(v: Views) -> DataFrame:
    """Whole groups are drawn."""
    return rounded(weighted.bootstrap(v.scores, ["receptor_id"], "bedroc", DRAWS, 15, unit="group_id"), "mean", "lower", "upper")


@query()
def q_paired_bootstrap(v: Views) -> DataFrame:
    """Every pair of receptors on the same draws of whole groups."""
    return rounded(weighted.paired_deltas(v.scores, "receptor_id", "bedroc", DRAWS, 16, unit="group_id"), "mean", "lower", "upper")


@query()
def q_balanced_folds(v: Views) -> DataFrame:
    rows = v.ligands.withColumn("g", F.concat_ws("-", "group_id", "source_id")).select("ligand_id", "label", "g")
    placed = folds.balanced_folds(folds.group_table(rows, "g", "label", ("active", "decoy")), 5)
    return folds.assign(rows, "g", placed).select("ligand_id", "label", F.col("g").alias("group_id"), "fold")


# --- geometry ---------------------------------------------------------------------------------------------

NEAR = "(SELECT a.point_id AS a, b.point_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM points a, points b WHERE a.cluster_id = 0 AND b.cluster_id > 0)"


CUTOFF = 0.25


def near_sides(v: Views, *names: str) -> list[DataFrame]:
    """The points of cluster 0 and those of later clusters, under these names."""
    side = lambda p, rows: rows.select(F.col("point_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in "xyz"])
    return [side(names[0], v.points.filter("cluster_id = 0")), side(names[1], v.points.filter("cluster_id > 0"))]


def near_points(v: Views) -> DataFrame:
    return geo.near_pairs(*near_sides(v, "a", "b"), CUTOFF)


@query(f"SELECT a, b, round(d, 6) AS distance FROM {NEAR} WHERE d <= 0.25")
def q_distance_join(v: Views) -> DataFrame:
    return near_points(v).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"SELECT b AS residue, round(min(d), 6) AS min_distance FROM {NEAR} WHERE d <= 0.25 GROUP BY b")
def q_pocket_residues(v: Views) -> DataFrame:
    zero, others = near_sides(v, "b", "a")
    return geo.nearest(others, zero, CUTOFF).select(F.col("a").alias("residue"), F.round("least", 6).alias("min_distance"))


@query("SELECT cluster_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM points GROUP BY cluster_id")
def q_centroid_agg(v: Views) -> DataFrame:
    return v.points.groupBy("cluster_id").agg(*[F.round(F.avg(c), 6).alias(c) for c in "xyz"], F.count(F.lit(1)).alias("n"))


MATCHED = "(SELECT a.cluster_id AS a_id, a.x, a.y, a.z, b.x AS u, b.y AS v, b.z AS w FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY point_id) AS n FROM points) a JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY point_id) AS n FROM points) b ON a.n = b.n AND b.cluster_id = 0)"


def matched(v: Views) -> DataFrame:
    """Points of each cluster beside those of cluster 0, by position."""
    n = v.points.withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("point_id")))
    a = n.select("cluster_id", "n", *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    return a.join(n.filter("cluster_id = 0").select("n", *[F.col(c).alias(f"b_{c}") for c in "xyz"]), "n")


@query(f"SELECT a_id AS cluster_id, round(sqrt(avg((x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w))), 6) AS rmsd FROM {MATCHED} GROUP BY a_id")
def q_rmsd(v: Views) -> DataFrame:
    return rounded(geo.rmsd(matched(v), ["cluster_id"]), "rmsd")


@query()
def q_rigid_alignment(v: Views) -> DataFrame:
    return geo.align(matched(v), "cluster_id").select("cluster_id", F.round("rmsd", 6).alias("rmsd"))


@query("SELECT point_id, round(-y + 1, 6) AS x, round(x - 2, 6) AS y, round(z + 0.5, 6) AS z FROM points")
def q_affine_transform(v: Views) -> DataFrame:
    turned = geo.affine(v.points, [[0, 1, 0], [-1, 0, 0], [0, 0, 1]], [1, -2, 0.5])
    return turned.select("point_id", *[F.round(c, 6).alias(c) for c in "xyz"])


WITHIN = "(SELECT a.cluster_id, a.point_id AS a, b.point_id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM points a JOIN points b ON a.cluster_id = b.cluster_id AND a.point_id <> b.point_id)"


@query(f"SELECT cluster_id, a, b, round(d, 6) AS distance FROM {WITHIN}")
def q_pairwise_distance(v: Views) -> DataFrame:
    return rounded(geo.within(v.points, "cluster_id", "point_id"), "distance")


@query(f"SELECT cluster_id, a AS medoid, round(m, 6) AS mean_distance FROM (SELECT cluster_id, a, avg(d) AS m, row_number() OVER (PARTITION BY cluster_id ORDER BY round(sum(d), 9), a) AS n FROM {WITHIN} GROUP BY cluster_id, a) WHERE n = 1")
def q_medoids(v: Views) -> DataFrame:
    return rounded(geo.medoids(v.points, "cluster_id", "point_id"), "mean_distance")


@query("""WITH d AS (SELECT a.point_id, a.cluster_id, b.cluster_id AS o, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS m FROM points a, points b WHERE a.point_id <> b.point_id GROUP BY 1, 2, 3),
s AS (SELECT point_id, cluster_id, max(m) FILTER (o = cluster_id) AS own, min(m) FILTER (o <> cluster_id) AS other FROM d GROUP BY 1, 2)
SELECT point_id, cluster_id, round(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END, 6) AS silhouette FROM s""")
def q_silhouette(v: Views) -> DataFrame:
    return rounded(geo.silhouette(v.points, "cluster_id", "point_id"), "silhouette")


@query("SELECT cluster_id, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rmsf FROM points GROUP BY cluster_id")
def q_rmsf(v: Views) -> DataFrame:
    return rounded(geo.rmsf(v.points, "cluster_id"), "rmsf")


@query("SELECT cluster_id, " + ", ".join(f"round(least(min({c}) - ({m} - {w} / 2), ({m} + {w} / 2) - max({c})), 6) AS margin_{c}" for c, m, w in (("x", "0.0E0", "2.0E0"), ("y", "0.1E0", "3.0E0"), ("z", "0.0E0", "1.0E0"))) + " FROM points GROUP BY cluster_id")
def q_box_margins(v: Views) -> DataFrame:
    return rounded(geo.box_margins(v.points, ["cluster_id"], (0.0, 0.1, 0.0), (2.0, 3.0, 1.0)), "margin_x", "margin_y", "margin_z")


CENTERS = "ce AS (SELECT cluster_id AS c, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY cluster_id), di AS (SELECT a.c AS a, b.c AS b, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 9) AS d FROM ce a, ce b)"


@query(f"""WITH {CENTERS}, m0 AS (SELECT min(c) AS c FROM ce), m1 AS (SELECT a AS c FROM di, m0 WHERE b = m0.c AND a <> m0.c ORDER BY d DESC, a LIMIT 1),
m2 AS (SELECT a AS c FROM di WHERE b IN (SELECT c FROM m0 UNION ALL SELECT c FROM m1) AND a NOT IN (SELECT c FROM m0 UNION ALL SELECT c FROM m1) GROUP BY a ORDER BY min(d) DESC, a LIMIT 1)
SELECT c AS cluster_id, 0 AS step FROM m0 UNION ALL SELECT c, 1 FROM m1 UNION ALL SELECT c, 2 FROM m2""")
def q_maxmin_select(v: Views) -> DataFrame:
    """The most spread clusters, by their centres: a table of one row per cluster goes to the driver."""
    c = geo.centres(v.points, "cluster_id")
    ids = sorted(r["cluster_id"] for r in c)
    at = {r["cluster_id"]: (r["x"], r["y"], r["z"]) for r in c}
    d = {(a, b): round(sum((p - q) ** 2 for p, q in zip(at[a], at[b], strict=True)), 9) for a in ids for b in ids}
    order = geo.maxmin_order(ids, d, ids[0], 3)
    return v.spark.createDataFrame([(c, i) for i, c in enumerate(order)], "cluster_id int, step int")


@query()
def q_ward_clusters(v: Views) -> DataFrame:
    return geo.ward(v.points, "cluster_id", "point_id", ["x", "y", "z"], 3)


# --- resumption ---------------------------------------------------------------------------------------------


@query("SELECT ligand_id, r_regionkey AS receptor_id, seed FROM ligands, region, range(0, 3) t(seed) EXCEPT SELECT ligand_id, receptor_id, seed FROM poses WHERE status = 'ok'")
def q_resume_pending(v: Views) -> DataFrame:
    """Cells of ligand, receptor and replicate without a successful pose."""
    from orrery.streaming.resume import pending

    region = v.table("region").select(F.col("r_regionkey").alias("receptor_id"))
    work = rel.expected_grid(v.ligands.select("ligand_id"), region).withColumn("seed", F.explode(F.lit(list(SEEDS))))
    return pending(work, v.poses, ["ligand_id", "receptor_id", "seed"])


@query("SELECT r_regionkey AS receptor_id, (SELECT count(DISTINCT ligand_id) FROM pair_scores WHERE receptor_id = r_regionkey) = (SELECT count(*) FROM ligands) AS complete FROM region")
def q_table_complete(v: Views) -> DataFrame:
    total = v.ligands.agg(F.count(F.lit(1)).alias("t"))
    have = v.pair_scores.groupBy("receptor_id").agg(F.count_distinct("ligand_id").alias("h"))
    region = v.table("region").select(F.col("r_regionkey").alias("receptor_id"))
    out = region.join(have, "receptor_id", "left").crossJoin(total)
    return out.select("receptor_id", (F.coalesce("h", F.lit(0)) == F.col("t")).alias("complete"))


@query("""SELECT seed, receptor_id, mean_score, stop_before FROM (SELECT seed, receptor_id, mean_score, coalesce(bool_or(mean_score > -400) OVER (PARTITION BY receptor_id ORDER BY seed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stop_before
  FROM (SELECT seed, receptor_id, round(avg(score), 6) AS mean_score FROM seed_scores GROUP BY seed, receptor_id))""")
def q_early_stop_ladder(v: Views) -> DataFrame:
    """Profiles in order; those after the first that fails are not run."""
    steps = v.seed_scores.groupBy("seed", "receptor_id").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    before = Window.partitionBy("receptor_id").orderBy("seed").rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("stop_before", F.coalesce(F.bool_or(F.col("mean_score") > -400).over(before), F.lit(False)))

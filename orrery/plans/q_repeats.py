"""Queries: repeated cross-validation that goes on where it was left, annealing against the exact minimum, matched atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import anneal, folds, gates, pocket
from orrery.operators import geometry as geo
from orrery.operators import objective as obj
from orrery.operators import subsets as sub
from orrery.operators.ranksums import billionths, subset_metrics
from orrery.plans.q_core import DOUBLES, METRICS, rounded
from orrery.plans.q_select import BASE, NAME, SENSITIVITY, _grid, pair_terms, unary_terms
from orrery.plans.registry import query
from orrery.plans.views import RECEPTORS, Views
from orrery.streaming import repeats, resume

K = 5
SCHEMA = "repeat int, seed int"
#: The second call asks for more repeats and has another seed for the second one.
FIRST = [{"repeat": r, "seed": 40 + r} for r in (0, 1)]
SECOND = [{"repeat": r, "seed": 41 + r if r == 1 else 40 + r} for r in range(4)]
LEAST_DELTA, FALLBACK = 0.0, "single_best"


def repeated_cv(scores: DataFrame, configs: DataFrame) -> DataFrame:
    """``config_hash, repeat, method`` and held-out metrics pooled over the folds of each repeat.

    Each fold takes the scorer that the other folds find best, ``single_best``, or the least
    (``all_min``) or mean (``all_mean``) score over all scorers. All repeats are key columns.
    """
    scores = folds.checkpointed(scores.select("ligand_id", "label", "receptor_id", "score"))
    ids = scores.select("ligand_id", "label").distinct().join(F.broadcast(configs))  # configs: a row for each repeat
    order = F.sha2(F.concat(F.col("seed").cast("string"), F.lit("|"), F.col("ligand_id").cast("string")), 256)
    placed = folds.hash_ranked(ids, ["config_hash", "repeat", "label"], order, "ligand_id")
    placed = folds.checkpointed(placed.select("config_hash", "repeat", "ligand_id", ((F.col("__to_n") - 1) % K).cast("int").alias("fold")))
    rows = scores.join(placed, "ligand_id")
    train = rows.withColumn("held", F.explode(F.lit(list(range(K))))).filter("held <> fold")
    keys = ["config_hash", "repeat"]
    single = sub.k_subsets(scores.sparkSession, RECEPTORS, (1,))
    found = subset_metrics(train.withColumn("score", billionths("score")), single, RECEPTORS, [*keys, "held"])
    found = rounded(found.join(F.broadcast(single.select("mask", F.col("subset")[0].alias("receptor_id"))), "mask"), "bedroc")
    best = obj.pick(found, [*keys, "held"], F.desc("bedroc"), "receptor_id").select(*keys, F.col("held").alias("fold"), "receptor_id", F.lit(True).alias("best"))
    marked = rows.join(F.broadcast(best), [*keys, "fold", "receptor_id"], "left")  # best: a row for each fold
    methods = {"single_best": F.max(F.when(F.col("best"), F.col("score"))), "all_min": F.min("score"), "all_mean": F.round(F.avg("score"), 9)}
    wide = marked.groupBy(*keys, "ligand_id", "label").agg(*[c.alias(m) for m, c in methods.items()])
    names = sub.k_subsets(scores.sparkSession, list(methods), (1,))
    long = wide.unpivot([*keys, "ligand_id", "label"], list(methods), "receptor_id", "score").withColumn("score", billionths("score"))
    out = subset_metrics(folds.checkpointed(long), names, list(methods), keys).join(F.broadcast(names.select("mask", F.col("subset")[0].alias("method"))), "mask")
    return rounded(out, *DOUBLES).select(*keys, "method", "roc_auc", "average_precision", "bedroc")


def _cv_sql(configs: list[dict]) -> str:
    values = ", ".join(f"({c['repeat']}, {c['seed']}, '{repeats.config_hash(c)}')" for c in configs)
    return f"""cg AS (SELECT * FROM (VALUES {values}) t(repeat, seed, config_hash)), li AS (SELECT DISTINCT ligand_id, label FROM scores),
pl AS (SELECT repeat, config_hash, ligand_id, CAST((row_number() OVER (PARTITION BY repeat, label ORDER BY sha256(seed || '|' || ligand_id), ligand_id) - 1) % {K} AS INT) AS fold FROM li, cg),
rw AS (SELECT repeat, config_hash, fold, scores.* FROM scores JOIN pl USING (ligand_id)), tn AS (SELECT rw.*, held FROM rw, range(0, {K}) t(held) WHERE held <> fold),
tb AS (SELECT * FROM (WITH {METRICS.format(keys="repeat, held, receptor_id", rows="tn")} SELECT * FROM mx)),
bs AS (SELECT * FROM (SELECT repeat, held, receptor_id, row_number() OVER (PARTITION BY repeat, held ORDER BY bedroc DESC NULLS LAST, receptor_id) AS nth FROM tb) WHERE nth = 1),
mt AS (SELECT repeat, 'all_min' AS method, ligand_id, label, min(score) AS score FROM rw GROUP BY ALL UNION ALL SELECT repeat, 'all_mean', ligand_id, label, round(avg(score), 9) FROM rw GROUP BY ALL
  UNION ALL SELECT rw.repeat, 'single_best', ligand_id, label, score FROM rw JOIN bs ON bs.repeat = rw.repeat AND bs.held = rw.fold AND bs.receptor_id = rw.receptor_id),
cv AS (SELECT * FROM (WITH {METRICS.format(keys="repeat, method", rows="mt")} SELECT * FROM mx))"""


_KEPT = [c for c in SECOND if c in FIRST]


@query(f"""WITH {_cv_sql(SECOND)} SELECT repeat, config_hash, method, cv.roc_auc, cv.average_precision, cv.bedroc, config_hash NOT IN ({", ".join(f"'{repeats.config_hash(c)}'" for c in _KEPT)}) AS computed
  FROM cv JOIN cg USING (repeat)""")
def q_repeat_resume(v: Views) -> DataFrame:
    """Two calls on one folder: the second asks for four repeats, of which one is stored, two are new and one has another seed; only three are computed."""
    folder = resume.scratch(v.spark, "runs")
    compute = lambda table: repeated_cv(v.scores, table)
    repeats.run_repeats(v.spark, folder, FIRST, SCHEMA, compute)
    out, done = repeats.run_repeats(v.spark, folder, SECOND, SCHEMA, compute)
    return out.withColumn("computed", F.col("config_hash").isin(done))


REPEATS = [{"repeat": r, "seed": 60 + r} for r in range(6)]


@query(f"""WITH {_cv_sql(REPEATS)}, dl AS (SELECT c.method, c.bedroc - s.bedroc AS delta, c.roc_auc - s.roc_auc AS auc_delta FROM cv c JOIN cv s ON s.repeat = c.repeat AND s.method = 'single_best' AND c.method <> 'single_best'),
sm AS (SELECT method, count(*) AS repeats, round(avg(delta), 6) AS mean_delta, round(stddev_pop(delta), 6) AS std_delta, round(min(delta), 6) AS min_delta, round(max(delta), 6) AS max_delta, count(*) FILTER (delta > 0) AS positive, round(avg(auc_delta), 6) AS mean_auc_delta FROM dl GROUP BY method)
SELECT *, min_delta >= {LEAST_DELTA} AND mean_auc_delta >= 0 AS reliable, coalesce((SELECT method FROM sm WHERE min_delta >= {LEAST_DELTA} AND mean_auc_delta >= 0 ORDER BY mean_delta DESC, method LIMIT 1), '{FALLBACK}') AS selected FROM sm""")
def q_repeated_cv(v: Views) -> DataFrame:
    """Differences from the single best scorer over six repeats; the most reliable method is selected, or the configured fallback where none is."""
    table = v.spark.createDataFrame([(*c.values(), repeats.config_hash(c)) for c in REPEATS], f"{SCHEMA}, config_hash string")
    found = folds.checkpointed(repeated_cv(v.scores, table))
    base = found.filter(F.col("method") == "single_best").select("repeat", F.col("bedroc").alias("b"), F.col("roc_auc").alias("r"))
    d = found.filter(F.col("method") != "single_best").join(base, "repeat").withColumns({"delta": F.col("bedroc") - F.col("b"), "auc_delta": F.col("roc_auc") - F.col("r")})
    summary = d.groupBy("method").agg(
        F.count(F.lit(1)).alias("repeats"),
        F.avg("delta").alias("mean_delta"),
        F.stddev_pop("delta").alias("std_delta"),
        F.min("delta").alias("min_delta"),
        F.max("delta").alias("max_delta"),
        F.count_if(F.col("delta") > 0).alias("positive"),
        F.avg("auc_delta").alias("mean_auc_delta"),
    )
    summary = rounded(summary, "mean_delta", "std_delta", "min_delta", "max_delta", "mean_auc_delta")
    return gates.with_fallback(summary.withColumn("reliable", (F.col("min_delta") >= LEAST_DELTA) & (F.col("mean_auc_delta") >= 0)), "method", "reliable", "mean_delta", FALLBACK)


SEEDS = 11, 12, 13, 14, 15


@query(BASE + f""", gr AS (SELECT * FROM (VALUES {", ".join(f"({k}, {w}E0)" for k, w in SENSITIVITY)}) t(k, w)), sz AS (SELECT mask FROM range(1, 32) t(mask)),
hs AS (SELECT mask, k, w, sum(-roc_auc + 0.1E0 + (1 - 2 * k)) AS h FROM sz JOIN un ON (mask >> receptor_id) & 1 = 1, gr GROUP BY mask, k, w),
js AS (SELECT mask, k, w, sum(w * redundancy + 2) AS j FROM sz JOIN bi ON (mask >> a) & 1 = 1 AND (mask >> b) & 1 = 1, gr GROUP BY mask, k, w),
en AS (SELECT hs.mask, hs.k, hs.w, hs.k * hs.k + hs.h + coalesce(js.j, 0) AS energy FROM hs LEFT JOIN js ON js.mask = hs.mask AND js.k = hs.k AND js.w = hs.w),
b AS (SELECT *, row_number() OVER (PARTITION BY k, w ORDER BY round(energy, 9), {NAME}) AS n FROM en)
SELECT CAST(k AS INT) AS k, w, round(energy, 6) AS exact_energy, {len(SEEDS)} AS seeds, CAST({len(SEEDS)} AS BIGINT) AS matches, 1.0E0 AS match_rate FROM b WHERE n = 1""")
def q_annealing_rate(v: Views) -> DataFrame:
    """How many of five seeds anneal to the exact minimum, for each size and redundancy weight of the sensitivity grid."""
    grid = F.broadcast(v.spark.createDataFrame(SENSITIVITY, "k int, w double"))
    h = unary_terms(v).crossJoin(grid).select("k", "w", "member", (-F.col("roc_auc") + 0.1 + (1 - 2 * F.col("k"))).alias("h"))
    j = pair_terms(v).crossJoin(grid).select("k", "w", "a", "b", (F.col("w") * F.col("redundancy") + 2).alias("j"))
    found = anneal.anneal(h, j, ["k", "w"], SEEDS).join(_grid(v, SENSITIVITY).select("k", "w", F.col("energy").alias("exact")), ["k", "w"])
    same = F.abs(F.col("energy") + F.col("k") * F.col("k") - F.col("exact")) < 1e-7
    return found.groupBy("k", "w").agg(
        F.round(F.max("exact"), 6).alias("exact_energy"), F.count(F.lit(1)).cast("int").alias("seeds"), F.count_if(same).alias("matches"), (F.count_if(same) / F.count(F.lit(1))).alias("match_rate")
    )


_ATOMS = "SELECT vec_id, i, CASE WHEN i % 2 = 0 THEN 'C' ELSE 'N' END AS element, CAST(embedding[3 * i + 1] AS DOUBLE) AS x, CAST(embedding[3 * i + 2] AS DOUBLE) AS y, CAST(embedding[3 * i + 3] AS DOUBLE) AS z FROM embeddings, range(0, 6) t(i)"


@query(f"""WITH am AS ({_ATOMS}), pm AS (SELECT * FROM (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 2), (1, 0, 0), (1, 1, 2), (1, 2, 1), (2, 0, 1), (2, 1, 0), (2, 2, 2), (3, 0, 1), (3, 1, 2), (3, 2, 0), (4, 0, 2), (4, 1, 0), (4, 2, 1), (5, 0, 2), (5, 1, 1), (5, 2, 0)) t(p, r, c)),
ds AS (SELECT a.vec_id, a.element, a.i // 2 AS r, b.i // 2 AS c, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM am a JOIN am b ON b.vec_id = a.vec_id + 1 AND a.element = b.element),
cs AS (SELECT vec_id, element, p, sum(d) AS total, sum(d * d) AS squares, max(d) AS farthest FROM ds JOIN pm USING (r, c) GROUP BY vec_id, element, p),
bp AS (SELECT vec_id, arg_min(squares, total) AS squares, arg_min(farthest, total) AS farthest FROM cs GROUP BY vec_id, element),
fx AS (SELECT vec_id, sqrt(sum(d * d) / 6) AS fixed FROM ds WHERE r = c GROUP BY vec_id)
SELECT vec_id, round(sqrt(sum(squares) / 6), 6) AS rmsd, round(max(farthest), 6) AS farthest, round(any_value(fixed), 6) AS fixed_order FROM bp JOIN fx USING (vec_id) GROUP BY vec_id""")
def q_assignment_rmsd(v: Views) -> DataFrame:
    """Six atoms of two elements against those of the next structure, matched element by element, beside the deviation in their fixed order."""
    e = v.table("embeddings", "vec_id", "embedding")
    at = [F.struct(F.lit(i).alias("i"), F.lit("CN"[i % 2]).alias("element"), *[F.col("embedding")[3 * i + j].cast("double").alias(c) for j, c in enumerate("xyz")]) for i in range(6)]
    atoms = e.select("vec_id", F.explode(F.array(*at)).alias("s")).select("vec_id", "s.*")
    after = atoms.withColumn("vec_id", F.col("vec_id") - 1)
    matched = geo.assignment_rmsd(atoms, after, ["vec_id"]).filter("reason is null")
    sides = atoms.select("vec_id", "i", *[F.col(c).alias(f"a_{c}") for c in "xyz"]).join(after.select("vec_id", "i", *[F.col(c).alias(f"b_{c}") for c in "xyz"]), ["vec_id", "i"])
    fixed = geo.rmsd(sides, ["vec_id"]).select("vec_id", F.round("rmsd", 6).alias("fixed_order"))
    return matched.select("vec_id", F.round("rmsd", 6).alias("rmsd"), F.round("farthest", 6).alias("farthest")).join(fixed, "vec_id")


POCKET, ANCHORS, LEAST_SHARE = 10, [2, 5], 0.6
_RESIDUES = f"""rs AS (SELECT vec_id AS structure_id, CAST(i AS INT) AS residue, CASE WHEN abs(CAST(floor(256 * CAST(embedding[4 * i + 1] AS DOUBLE)) AS BIGINT)) % 23 = 1 THEN 'GLY' ELSE 'ALA' END AS name,
  CAST(embedding[3 * i + 1] AS DOUBLE) AS x, CAST(embedding[3 * i + 2] AS DOUBLE) AS y, CAST(embedding[3 * i + 3] AS DOUBLE) AS z FROM embeddings, range(0, {POCKET}) t(i)
  WHERE vec_id > 0 AND abs(CAST(floor(256 * CAST(embedding[4 * i + 2] AS DOUBLE)) AS BIGINT)) % 7 <> 1),
rf AS (SELECT CAST(i AS INT) AS residue, CAST(embedding[3 * i + 1] AS DOUBLE) AS x, CAST(embedding[3 * i + 2] AS DOUBLE) AS y, CAST(embedding[3 * i + 3] AS DOUBLE) AS z FROM embeddings, range(0, {POCKET}) t(i) WHERE vec_id = 0),
mt AS (SELECT w.structure_id, rf.residue, CASE WHEN name IS NULL THEN 'missing' WHEN name <> 'ALA' THEN 'mismatched' ELSE 'present' END AS state, CASE WHEN name = 'ALA' THEN rs.x ELSE rf.x END AS x, CASE WHEN name = 'ALA' THEN rs.y ELSE rf.y END AS y,
  CASE WHEN name = 'ALA' THEN rs.z ELSE rf.z END AS z FROM (SELECT DISTINCT structure_id FROM rs) w JOIN rf ON true LEFT JOIN rs ON rs.structure_id = w.structure_id AND rs.residue = rf.residue),
el AS (SELECT structure_id, count(*) FILTER (state = 'present') AS present, round(count(*) FILTER (state = 'present') * 1.0E0 / count(*), 6) AS share, coalesce(string_agg(residue, ';' ORDER BY residue) FILTER (state = 'missing'), '') AS missing,
  coalesce(string_agg(residue, ';' ORDER BY residue) FILTER (state = 'mismatched'), '') AS mismatched, coalesce(string_agg(residue, ';' ORDER BY residue) FILTER (state <> 'present' AND residue IN (2, 5)), '') AS missing_anchors, count(*) FILTER (state <> 'present') AS imputed FROM mt GROUP BY structure_id),
rz AS (SELECT *, concat_ws(';', CASE WHEN share < {LEAST_SHARE} THEN 'pocket_share_below_limit' END, CASE WHEN mismatched <> '' THEN 'pocket_name_mismatch' END, CASE WHEN missing_anchors <> '' THEN 'missing_anchor' END) AS reasons FROM el)"""


def _pocket(v: Views) -> DataFrame:
    e = v.table("embeddings", "vec_id", "embedding")
    step = lambda i, j, m: F.abs(F.floor(F.col("embedding")[4 * i + j].cast("double") * 256)) % m
    one = [
        F.struct(F.lit(i).alias("residue"), F.when(step(i, 0, 23) == 1, "GLY").otherwise("ALA").alias("name"), (step(i, 1, 7) != 1).alias("there"), *[F.col("embedding")[3 * i + j].cast("double").alias(c) for j, c in enumerate("xyz")])
        for i in range(POCKET)
    ]
    rows = e.select(F.col("vec_id").alias("structure_id"), F.explode(F.array(*one)).alias("s")).select("structure_id", "s.*")
    reference = rows.filter("structure_id = 0").select("residue", F.lit("ALA").alias("name"), *"xyz")
    return pocket.against_reference(rows.filter("structure_id > 0 and there").drop("there"), reference)


@query(f"WITH {_RESIDUES} SELECT *, reasons = '' AS eligible FROM rz")
def q_pocket_eligibility(v: Views) -> DataFrame:
    """Structures against the residues that the reference's pocket has: what is there, what is not, and why a structure is excluded."""
    return rounded(pocket.eligibility(_pocket(v), ANCHORS, LEAST_SHARE), "share")


@query(f"WITH {_RESIDUES} SELECT structure_id, a.residue AS a, b.residue AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS distance, a.state <> 'present' OR b.state <> 'present' AS imputed FROM mt a JOIN mt b USING (structure_id) JOIN rz USING (structure_id) WHERE a.residue < b.residue AND reasons = ''")
def q_pocket_features(v: Views) -> DataFrame:
    """Pairwise distances of the pocket in eligible structures, missing residues being taken from the reference."""
    matched = _pocket(v)
    return rounded(pocket.features(matched, pocket.eligibility(matched, ANCHORS, LEAST_SHARE)), "distance")

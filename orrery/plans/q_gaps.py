"""Queries: dataset audits, samples, guards, keyed reports, certified selection and resumable chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators import audit, folds, normalize, ranking
from orrery.operators import geometry as geo
from orrery.operators import relational as rel
from orrery.operators import subsets as sub
from orrery.operators.order import score_piece, spread
from orrery.plans.q_core import METRICS, q_metric_bundle, q_metrics_by_split
from orrery.plans.q_select import BASE, COEF, CUTOFF, ENERGY, FOLDS, NAME, NEAR, base_coefficients, folded, near_points, near_sides
from orrery.plans.registry import query
from orrery.plans.views import RECEPTORS, SEEDS, Views
from orrery.streaming import resume

# --- predicates and projections -----------------------------------------------------------

TEXT_RANK = "CASE WHEN seed = 1 THEN CAST(pose_rank AS VARCHAR) || '.0' ELSE CAST(pose_rank AS VARCHAR) END"


@query(f"SELECT ligand_id, receptor_id, seed, docking_score FROM poses WHERE {TEXT_RANK} = '1' AND status = 'ok'")
def q_rank_text_filter(v: Views) -> DataFrame:
    """Rank as a text, so that 1.0 is not 1."""
    text = F.col("pose_rank").cast("string")
    text = F.when(F.col("seed") == 1, F.concat(text, F.lit(".0"))).otherwise(text)
    return v.poses.filter((text == "1") & (F.col("status") == "ok")).select("ligand_id", "receptor_id", "seed", "docking_score")


@query("SELECT ligand_id, label, split FROM ligands WHERE split = 'train' AND label IN ('active', 'decoy') AND group_id <> ''")
def q_split_label_filter(v: Views) -> DataFrame:
    return v.ligands.filter((F.col("split") == "train") & F.col("label").isin("active", "decoy") & (F.col("group_id") != "")).select("ligand_id", "label", "split")


@query(f"""SELECT a, b, CASE WHEN a % 3 = 0 AND b % 3 = 0 AND d <= 0.15 THEN 'polar_candidate' WHEN a % 3 = 1 AND b % 3 = 1 AND d <= 0.2 THEN 'hydrophobic_candidate'
  ELSE 'close_contact' END AS contact FROM {NEAR} WHERE d <= 0.25""")
def q_contact_class(v: Views) -> DataFrame:
    """Kinds of contact, the first that fits; a point's element is its id modulo three."""
    both = lambda element, cutoff: (F.col("a") % 3 == element) & (F.col("b") % 3 == element) & (F.col("distance") <= cutoff)
    kind = rel.ladder((both(0, 0.15), "polar_candidate"), (both(1, 0.2), "hydrophobic_candidate"), otherwise="close_contact")
    return near_points(v).select("a", "b", kind.alias("contact"))


@query("SELECT ligand_id, printf('%s_A%04d', label, row_number() OVER (PARTITION BY label ORDER BY ligand_id)) AS position_id FROM ligands")
def q_position_id(v: Views) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("label").orderBy("ligand_id"))
    return v.ligands.select("ligand_id", F.format_string("%s_A%04d", "label", nth).alias("position_id"))


@query("SELECT point_id, 'C' || ':' || CASE WHEN point_id % 5 = 0 THEN '_' ELSE CAST(point_id % 5 AS VARCHAR) END || ':' || cluster_id AS residue FROM points")
def q_residue_label(v: Views) -> DataFrame:
    """Chain, insertion code (``_`` where blank) and number of a residue."""
    code = F.when(F.col("point_id") % 5 == 0, F.lit(" ")).otherwise((F.col("point_id") % 5).cast("string"))
    blank = F.when(F.trim(code) == "", F.lit("_")).otherwise(code)
    return v.points.select("point_id", F.concat_ws(":", F.lit("C"), blank, F.col("cluster_id").cast("string")).alias("residue"))


@query(f"WITH {METRICS.format(keys='split, receptor_id', rows='scores')} SELECT split, receptor_id, ligand_count, active_count, roc_auc, bedroc FROM mx")
def q_compact_metrics(v: Views) -> DataFrame:
    """Only the keys that a short report shows."""
    return q_metrics_by_split(v).select("split", "receptor_id", "ligand_count", "active_count", "roc_auc", "bedroc")


def bounded(score: str, bound: float) -> Column:
    c = F.col(score)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= bound)


@query("SELECT ligand_id, receptor_id, seed, pose_rank, docking_score IS NOT NULL AND isfinite(docking_score) AND abs(docking_score) <= 5 AS passed FROM poses")
def q_bounded_guard(v: Views) -> DataFrame:
    return v.poses.select("ligand_id", "receptor_id", "seed", "pose_rank", bounded("docking_score", 5.0).alias("passed"))


@query("""WITH e AS (SELECT event_type AS cluster_id, count(*) AS n, max(epoch(ts)) - min(epoch(ts)) AS s FROM events GROUP BY event_type), w AS (SELECT count(*) * 1.0E0 / (max(epoch(ts)) - min(epoch(ts))) AS r FROM events)
SELECT cluster_id, round(n * 1.0E0 / s, 9) AS rate, round(n * 1.0E0 / s / r, 6) AS speed_up FROM e, w""")
def q_speed_up(v: Views) -> DataFrame:
    """Events a second of each kind, over its own span of time, against the rate of all."""
    second = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")), F.col("ts")) / 1e6
    rate = F.count(F.lit(1)) / (F.max(second) - F.min(second))
    events = v.table("events", "event_type", "ts")
    out = events.groupBy(F.col("event_type").alias("cluster_id")).agg(rate.alias("rate")).crossJoin(F.broadcast(events.agg(rate.alias("reference"))))  # one row
    return out.select("cluster_id", F.round("rate", 9).alias("rate"), F.round(F.col("rate") / F.col("reference"), 6).alias("speed_up"))


# --- representatives, joins, pivots ---------------------------------------------------------


@query("""SELECT ligand_id, receptor_id, min(CASE WHEN pose_rank = 1 THEN docking_score END) AS first_rank, arg_min(pose_rank, docking_score * 100000 + pose_rank) AS best_pose_rank,
  min(docking_score) AS best_docking_score, count(*) AS pose_count, coalesce(min(CASE WHEN pose_rank = 1 THEN docking_score END), min(docking_score)) AS representative_score
  FROM poses WHERE status = 'ok' GROUP BY ligand_id, receptor_id""".replace("min(CASE WHEN pose_rank = 1 THEN docking_score END) AS first_rank, ", ""))
def q_representative_best_rank(v: Views) -> DataFrame:
    """The score of the first rank, but the rank of the best pose; a group without a good pose is an error."""
    return rel.representative_strict(v.poses.filter("status = 'ok'"), ["ligand_id", "receptor_id"])


@query("""SELECT coalesce(a.point_id, b.point_id) AS point_id, a.cluster_id AS name_a, b.name AS name_b, CASE WHEN b.point_id IS NULL THEN 'only_first' WHEN a.point_id IS NULL THEN 'only_second' WHEN a.cluster_id = b.name THEN 'matched' ELSE 'name_differs' END AS state
  FROM (SELECT point_id, cluster_id FROM points WHERE x >= -0.05) a FULL JOIN (SELECT point_id, CASE WHEN point_id % 7 = 0 THEN (cluster_id + 1) % 10 ELSE cluster_id END AS name FROM points WHERE y >= -0.05) b ON a.point_id = b.point_id""")
def q_residue_join(v: Views) -> DataFrame:
    """Two structures that each lack some residues, the second with some names changed: every residue of either, and how it matches."""
    name = F.when(F.col("point_id") % 7 == 0, (F.col("cluster_id") + 1) % 10).otherwise(F.col("cluster_id"))
    first = v.points.filter("x >= -0.05").select("point_id", F.col("cluster_id").alias("name"))
    second = v.points.filter("y >= -0.05").select("point_id", name.alias("name"))
    return rel.matched_residues(first, second, ["point_id"], "name")


@query("SELECT l.label, l.split, s.receptor_id, count(*) AS rows FROM pair_scores s JOIN ligands l USING (ligand_id) GROUP BY ALL")
def q_manifest_join(v: Views) -> DataFrame:
    """Long scores by pair key, with the manifest's columns; each pair must be in the manifest."""
    both = v.pair_scores.join(v.ligands.select("ligand_id", "label", "split"), "ligand_id", "left")
    both = audit.require(both, F.col("label").isNotNull(), "ligand of the manifest")
    return both.groupBy("label", "split", "receptor_id").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT ligand_id, r0, r1, r2, r3, r4 FROM wide")
def q_wide_strict(v: Views) -> DataFrame:
    """Long to wide; a missing cell is an error."""
    out = rel.pivot_strict(v.scores, ["ligand_id"], "receptor_id", RECEPTORS, "score")
    return out.select("ligand_id", *[F.col(str(r)).alias(f"r{r}") for r in RECEPTORS])


@query("""WITH d AS (SELECT cluster_id, point_id, sqrt(x * x + y * y + z * z) AS d, row_number() OVER (PARTITION BY cluster_id ORDER BY round(sqrt(x * x + y * y + z * z), 9), point_id) AS r FROM points)
SELECT cluster_id, string_agg(point_id || ':' || printf('%.2f', d), ',' ORDER BY r) AS closest FROM d WHERE r <= 10 GROUP BY cluster_id""")
def q_closest_list(v: Views) -> DataFrame:
    """The ten points next to the origin, nearest first, as ``id:distance``."""
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    order = Window.partitionBy("cluster_id").orderBy(F.round("d", 9), "point_id")
    near = v.points.withColumn("d", d).withColumn("r", F.row_number().over(order)).filter("r <= 10")
    cells = F.array_sort(F.collect_list(F.struct("r", F.format_string("%d:%.2f", "point_id", "d").alias("t"))))
    return near.groupBy("cluster_id").agg(F.array_join(F.transform(cells, lambda x: x["t"]), ",").alias("closest"))


# --- order ----------------------------------------------------------------------------------


@query("SELECT ligand_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('4|' || ligand_id), ligand_id) - 1) % 5 AS INT) AS fold FROM ligands")
def q_label_folds(v: Views) -> DataFrame:
    return folds.label_folds(v.ligands.select("ligand_id", "label"), "ligand_id", "label", 5, 4)


@query("SELECT ligand_id, CASE WHEN heavy_atoms = 7 THEN 9000 + heavy_atoms ELSE 100 + row_number() OVER (PARTITION BY group_id ORDER BY ligand_id) - 1 END AS seed FROM ligands")
def q_seed_by_position(v: Views) -> DataFrame:
    """Base and position, unless a row names its own offset."""
    at = F.row_number().over(Window.partitionBy("group_id").orderBy("ligand_id")) - 1
    return v.ligands.select("ligand_id", F.when(F.col("heavy_atoms") == 7, F.lit(9000) + F.col("heavy_atoms")).otherwise(F.lit(100) + at).cast("long").alias("seed"))


# --- audits -----------------------------------------------------------------------------------


def told(name: str, n: DataFrame) -> DataFrame:
    """``constraint, n_violations, passed`` from one row with ``n``."""
    return n.select(F.lit(name).alias("constraint"), F.col("n").cast("long").alias("n_violations"), (F.col("n") == 0).alias("passed"))


def one(name: str, sql: str) -> str:
    return f"SELECT '{name}' AS \"constraint\", CAST(n AS BIGINT) AS n_violations, n = 0 AS passed FROM ({sql})"


ROWS = one("row_count", "SELECT (SELECT count(*) FROM ligands) * (SELECT count(*) FROM region) - count(*) AS n FROM pair_scores")
UNIQUE = one("unique_key", "SELECT count(*) AS n FROM (SELECT ligand_id FROM ligands GROUP BY ligand_id HAVING count(*) > 1)")
HISTOGRAM = one(
    "label_histogram",
    "SELECT count(*) AS n FROM (SELECT label, count(*) AS c FROM ligands GROUP BY label) a FULL JOIN (SELECT label, count(DISTINCT ligand_id) AS c FROM scores GROUP BY 1) b ON a.label = b.label WHERE a.c IS DISTINCT FROM b.c",
)
FORBIDDEN = one("forbidden_split", "SELECT count(*) AS n FROM scores WHERE split = 'test'")
COMPLETE = one("receptors_per_ligand", "SELECT count(*) AS n FROM (SELECT ligand_id FROM pair_scores GROUP BY ligand_id HAVING count(DISTINCT receptor_id) <> 5)")
SEED_KEYS = one(
    "seed_key_sets",
    "SELECT count(*) AS n FROM (SELECT ligand_id, receptor_id FROM seed_scores GROUP BY ligand_id, receptor_id HAVING count(DISTINCT seed) <> 3)",
)
FINITE = one("finite_score", "SELECT count(*) FILTER (docking_score IS NULL OR NOT isfinite(docking_score)) AS n FROM poses")
FOLD_LABELS = one("fold_labels", "SELECT count(*) AS n FROM (SELECT fold FROM fo GROUP BY fold HAVING count(DISTINCT label) < 2)")


def histogram_audit(df: DataFrame, expected: DataFrame, label: str) -> DataFrame:
    found = df.groupBy(label).agg(F.count(F.lit(1)).alias("found"))
    wrong = found.join(expected, label, "full").filter(~F.col("found").eqNullSafe(F.col("expected")))
    return told("label_histogram", wrong.agg(F.count(F.lit(1)).alias("n")))


def group_size_audit(name: str, df: DataFrame, keys: list[str], member: str, size: int) -> DataFrame:
    odd = df.groupBy(*keys).agg(F.count_distinct(member).alias("c")).filter(F.col("c") != size)
    return told(name, odd.agg(F.count(F.lit(1)).alias("n")))


@query(ROWS)
def q_row_count_audit(v: Views) -> DataFrame:
    """Pair scores against the full grid of ligands and receptors."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(v.ligands, "l").crossJoin(n(v.table("region"), "r")).crossJoin(n(v.pair_scores, "s"))  # one row each
    return told("row_count", counts.select((F.col("l") * F.col("r") - F.col("s")).alias("n")))


@query(UNIQUE)
def q_unique_key_audit(v: Views) -> DataFrame:
    return audit.unique_key(v.ligands, ["ligand_id"])


@query(HISTOGRAM)
def q_label_histogram_audit(v: Views) -> DataFrame:
    """Labels of all ligands against those of the ligands that have a score for every receptor."""
    expected = v.scores.groupBy("label").agg(F.count_distinct("ligand_id").alias("expected"))
    return histogram_audit(v.ligands, expected, "label")


@query(FORBIDDEN)
def q_forbidden_split(v: Views) -> DataFrame:
    return told("forbidden_split", v.scores.agg(F.count_if(F.col("split") == "test").alias("n")))


@query(f"{COMPLETE} UNION ALL {SEED_KEYS}")
def q_receptor_completeness(v: Views) -> DataFrame:
    whole = group_size_audit("receptors_per_ligand", v.pair_scores, ["ligand_id"], "receptor_id", len(RECEPTORS))
    return whole.unionByName(group_size_audit("seed_key_sets", v.seed_scores, ["ligand_id", "receptor_id"], "seed", len(SEEDS)))


@query(FINITE)
def q_finite_scores(v: Views) -> DataFrame:
    c = F.col("docking_score")
    return told("finite_score", v.poses.agg(F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias("n")))


@query(f"WITH {FOLDS} {FOLD_LABELS}")
def q_fold_labels_audit(v: Views) -> DataFrame:
    odd = folded(v).groupBy("fold").agg(F.count_distinct("label").alias("c")).filter("c < 2")
    return told("fold_labels", odd.agg(F.count(F.lit(1)).alias("n")))


@query(" UNION ALL ".join([ROWS, UNIQUE, HISTOGRAM, FORBIDDEN, COMPLETE, SEED_KEYS, FINITE]))
def q_dataset_audit(v: Views) -> DataFrame:
    """All constraints on the inputs of a selection at a time."""
    parts = [q_row_count_audit(v), q_unique_key_audit(v), q_label_histogram_audit(v), q_forbidden_split(v), q_receptor_completeness(v), q_finite_scores(v)]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT ligand_id, label, split FROM ligands WHERE split <> 'test' AND (SELECT count(*) FROM (SELECT ligand_id FROM ligands GROUP BY ligand_id HAVING count(*) > 1)) = 0")
def q_visible_splits(v: Views) -> DataFrame:
    """The rows of the visible splits; the tasks fail where the table's audit does not hold."""
    holds = F.broadcast(q_unique_key_audit(v).select("passed"))  # one row
    rows = v.ligands.filter("split <> 'test'").select("ligand_id", "label", "split").crossJoin(holds)
    return audit.require(rows, F.col("passed"), "unique ids").drop("passed")


@query("""SELECT ligand_id, s.label, l.label AS panel_label FROM (SELECT ligand_id, CASE WHEN heavy_atoms <= 11 THEN 'active' ELSE 'decoy' END AS label, split, group_id FROM ligands) s
  JOIN ligands l USING (ligand_id) WHERE s.label <> l.label OR s.split <> l.split OR s.group_id <> l.group_id""")
def q_panel_match(v: Views) -> DataFrame:
    """Prepared rows that disagree with the panel in label, split or group."""
    label = F.when(F.col("heavy_atoms") <= 11, "active").otherwise("decoy")
    prepared = v.ligands.select("ligand_id", label.alias("label"), "split", "group_id")
    panel = v.ligands.select("ligand_id", *[F.col(c).alias(f"panel_{c}") for c in ("label", "split", "group_id")])
    differs = reduce(lambda a, b: a | b, [F.col(c) != F.col(f"panel_{c}") for c in ("label", "split", "group_id")])
    return prepared.join(panel, "ligand_id").filter(differs).select("ligand_id", "label", "panel_label")


#: BEDROC from its robust initial enhancement, enrichment as hits over the hits expected.
_SECOND = """sc AS (SELECT receptor_id, score, count(*) FILTER (label = 'active') AS a, count(*) FILTER (label <> 'active') AS d FROM scores GROUP BY ALL),
sd AS (SELECT *, sum(a) OVER (PARTITION BY receptor_id ORDER BY score) AS up FROM sc), au AS (SELECT receptor_id, sum(d * (up - a / 2.0E0)) / sum(a) / sum(d) AS auc FROM sd GROUP BY receptor_id),
rn AS (SELECT receptor_id, label, row_number() OVER (PARTITION BY receptor_id ORDER BY score, ligand_id) AS r, count(*) OVER (PARTITION BY receptor_id) AS n, count(*) FILTER (label = 'active') OVER (PARTITION BY receptor_id) AS m FROM scores),
sn AS (SELECT receptor_id, max(n) AS n, max(m) AS m, sum(exp(-20.0E0 * r / n)) FILTER (label = 'active') / max(m) / ((1 - exp(-20.0E0)) / (exp(20.0E0 / max(n)) - 1) / max(n)) AS rie,
  count(*) FILTER (label = 'active' AND r <= greatest(1, ceil(n * 0.1E0))) AS hits FROM rn GROUP BY receptor_id),
sr AS (SELECT receptor_id, rie * (m * 1.0E0 / n) * ((exp(10) - exp(-10)) / 2) / ((exp(10) + exp(-10)) / 2 - (exp(10 - 20.0E0 * m / n) + exp(-10 + 20.0E0 * m / n)) / 2) + 1 / (1 - exp(20 * (1 - m * 1.0E0 / n))) AS bedroc2,
  hits * n * 1.0E0 / (greatest(1, ceil(n * 0.1E0)) * m) AS ef2 FROM sn)"""


@query(f"""WITH {METRICS.format(keys='receptor_id', rows='scores')}, {_SECOND} SELECT receptor_id, roc_auc, average_precision, bedroc, ef10, round(auc, 5) AS second_auc, round(bedroc2, 5) AS second_bedroc, round(ef2, 5) AS second_ef10,
  abs(roc_auc - auc) < 1E-6 AND abs(bedroc - bedroc2) < 1E-6 AND abs(ef10 - ef2) < 1E-6 AS agrees FROM mx JOIN au USING (receptor_id) JOIN sr USING (receptor_id)""")
def q_metrics_audit(v: Views) -> DataFrame:
    """Metrics against a second formulation: the trapezoid over thresholds, precision times the step in recall, BEDROC by its enhancement, hits over expected hits."""
    at = v.scores.groupBy("receptor_id", "score").agg(F.count_if(F.col("label") == "active").alias("a"), F.count_if(F.col("label") != "active").alias("d"))
    at = spread(at, ["receptor_id"], score_piece("score"), ["score"], {"a": F.col("a"), "d": F.col("d")})
    area = F.sum(F.col("d") * (F.col("__to_a") - F.col("a") / 2.0)) / F.max("__all_a") / F.max("__all_d")
    rows = v.scores.withColumn("hit", (F.col("label") == "active").cast("int"))
    rows = spread(rows, ["receptor_id"], score_piece("score"), ["score", "ligand_id"], {"hit": F.col("hit")})
    r, n, hit = F.col("__to_n"), F.col("__all_n"), F.col("hit")
    sums = rows.groupBy("receptor_id").agg(
        F.max(n).alias("n"),
        F.max("__all_hit").alias("m"),
        (F.sum(hit * F.col("__to_hit") / r) / F.sum("hit")).alias("ap"),
        F.sum(hit * F.exp(-20.0 * r / n)).alias("decay"),
        F.sum(F.when(r <= ranking.top_count(n, 0.1), hit)).alias("hits"),
    )
    n, m = F.col("n"), F.col("m")
    enhancement = F.col("decay") / m / ((1 - F.exp(F.lit(-20.0))) / (F.exp(20.0 / n) - 1) / n)
    share = m / n
    bedroc = enhancement * share * F.sinh(F.lit(10.0)) / (F.cosh(F.lit(10.0)) - F.cosh(10 - 20 * share)) + 1 / (1 - F.exp(20 * (1 - share)))
    second = sums.select("receptor_id", "ap", bedroc.alias("b"), (F.col("hits") * n / (ranking.top_count(n, 0.1) * m)).alias("e"))
    second = second.join(at.groupBy("receptor_id").agg(area.alias("auc")), "receptor_id")
    out = q_metric_bundle(v).join(second, "receptor_id")
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-6
    agrees = near("roc_auc", "auc") & near("average_precision", "ap") & near("bedroc", "b") & near("ef10", "e")
    told_ = [F.round(c, 5).alias(n) for c, n in (("auc", "second_auc"), ("b", "second_bedroc"), ("e", "second_ef10"))]
    return out.select("receptor_id", "roc_auc", "average_precision", "bedroc", "ef10", *told_, agrees.alias("agrees"))


# --- scaling and selection -----------------------------------------------------------------------


@query("""SELECT ligand_id, receptor_id, round((score - avg(score) OVER w) / stddev_pop(score) OVER w / sqrt(5), 6) AS z FROM scores WINDOW w AS (PARTITION BY receptor_id)""")
def q_scaled_features(v: Views) -> DataFrame:
    """Z-scores divided by the root of the number of features, so that distances do not grow with it."""
    z = normalize.standardize(v.scores, "receptor_id", "score")
    return z.select("ligand_id", "receptor_id", F.round(F.col("z") / F.sqrt(F.lit(len(RECEPTORS))), 6).alias("z"))


@query("""SELECT group_id, round(CASE WHEN hi = lo THEN 0.5 ELSE (m - lo) / (hi - lo) END, 6) AS utility FROM (SELECT *, min(m) OVER () AS lo, max(m) OVER () AS hi FROM (SELECT group_id, avg(weight) AS m FROM ligands GROUP BY group_id))""")
def q_utility_minmax(v: Views) -> DataFrame:
    """Utilities between 0 and 1; where all are alike, one half."""
    means = v.ligands.groupBy("group_id").agg(F.avg("weight").alias("m"))
    return means.select("group_id", F.round(normalize.minmax("m", [], 0.5), 6).alias("utility"))


CERTIFIED = f""", lin AS (SELECT row_number() OVER (ORDER BY h, r) AS i, sum(h + 3) OVER (ORDER BY h, r ROWS UNBOUNDED PRECEDING) AS s FROM h),
quad AS (SELECT row_number() OVER (ORDER BY j, a, b) AS i, sum(j - 2) OVER (ORDER BY j, a, b ROWS UNBOUNDED PRECEDING) AS s FROM j),
lb AS (SELECT min((k - 2) * (k - 2) + coalesce(lin.s, 0) + coalesce(quad.s, 0)) AS least FROM range(0, 6) t(k) LEFT JOIN lin ON lin.i = k LEFT JOIN quad ON quad.i = k * (k - 1) / 2 WHERE k <> 2),
sl AS (SELECT {NAME} AS subset, energy FROM en WHERE size = 2 ORDER BY round(energy, 9), subset LIMIT 1)
SELECT subset, round(energy, 8) AS energy, round(least, 8) AS lower_bound, least >= energy AS certified FROM sl, lb"""


@query(BASE + COEF.format(k=2, w=0.25) + ENERGY.format(c="4.0E0") + CERTIFIED)
def q_qubo_certified(v: Views) -> DataFrame:
    """The best subset of the wanted size, and a bound below all other sizes that says whether it is the best of all."""
    h, j, c = base_coefficients(v)
    best = sub.best_subset(sub.energies(sub.k_subsets(v.spark, RECEPTORS, [2]), h, j, c))
    bound = sub.lower_bound(h, j, 2, 1.0)
    out = best.crossJoin(bound)  # one row each
    return out.select(
        sub.subset_name("subset").alias("subset"), F.round("energy", 8).alias("energy"), F.round("least", 8).alias("lower_bound"), (F.col("least") >= F.col("energy")).alias("certified")
    )


@query(BASE + COEF.format(k=2, w=0.25) + ENERGY.format(c="4.0E0") + f" SELECT {NAME} AS subset, round(energy, 8) AS energy FROM en WHERE size = 2 AND mask & 1 = 1 ORDER BY round(energy, 9), subset LIMIT 1")
def q_qubo_required(v: Views) -> DataFrame:
    """The best subset of the wanted size that holds the required members."""
    h, j, c = base_coefficients(v)
    subsets = sub.with_members(sub.k_subsets(v.spark, RECEPTORS, [2]), [RECEPTORS[0]])
    best = sub.best_subset(sub.energies(subsets, h, j, c))
    return best.select(sub.subset_name("subset").alias("subset"), F.round("energy", 8).alias("energy"))


@query("""SELECT g.label, g.split, g.seed, g.receptor_id, count(s.score) AS scores, round(min(s.score), 6) AS best FROM (SELECT * FROM (SELECT DISTINCT label FROM ligands), (SELECT DISTINCT split FROM ligands), (SELECT DISTINCT seed FROM seed_scores), (SELECT r_regionkey AS receptor_id FROM region)) g
  LEFT JOIN (SELECT l.label, l.split, q.seed, q.receptor_id, q.score FROM seed_scores q JOIN ligands l ON l.ligand_id = q.ligand_id WHERE q.score < -9) s ON s.label = g.label AND s.split = g.split AND s.seed = g.seed AND s.receptor_id = g.receptor_id GROUP BY ALL""")
def q_parameter_grid(v: Views) -> DataFrame:
    """Every combination of label, split, replicate and receptor that the tables know, with its good scores, be there none."""
    grid = sub.value_grid(v.ligands.select("label"), v.ligands.select("split"), v.seed_scores.select("seed"), v.table("region").select(F.col("r_regionkey").alias("receptor_id")))
    good = v.seed_scores.filter("score < -9").join(v.ligands.select("ligand_id", "label", "split"), "ligand_id").drop("ligand_id")
    keys = ["label", "split", "seed", "receptor_id"]
    found = good.groupBy(*keys).agg(F.count("score").alias("scores"), F.min("score").alias("best"))
    return grid.join(found, keys, "left").select(*keys, F.coalesce("scores", F.lit(0)).alias("scores"), F.round("best", 6).alias("best"))


# --- splits and samples ------------------------------------------------------------------------------


@query()
def q_split_assignment(v: Views) -> DataFrame:
    """Whole groups to splits: the least overshoot, then the least distance from the targets, then the name."""
    rows = v.ligands.withColumn("g", F.concat_ws("-", "group_id", "source_id")).select("ligand_id", "label", "g")
    groups = folds.group_table(rows, "g", "label", ("active", "decoy"))
    placed = folds.greedy_splits(groups, {"train": 0.6, "validation": 0.2, "test": 0.2})
    table = v.spark.createDataFrame(list(placed.items()), "g string, split string")
    return rows.join(table, "g").select("ligand_id", "label", F.col("g").alias("group_id"), "split")


DIVERSE = """WITH o AS (SELECT ligand_id, label, group_id, sha256('8|' || ligand_id) AS h FROM ligands WHERE split = 'train'),
f AS (SELECT *, row_number() OVER (PARTITION BY label, group_id ORDER BY h, ligand_id) AS g FROM o),
a AS (SELECT ligand_id, label, group_id FROM f WHERE label = 'active' AND g = 1 ORDER BY h, ligand_id LIMIT 8),
d AS (SELECT ligand_id, label, group_id FROM f WHERE label = 'decoy' AND g = 1 AND group_id NOT IN (SELECT group_id FROM a) ORDER BY h, ligand_id LIMIT 8)
SELECT * FROM a UNION ALL SELECT * FROM d"""


@query(DIVERSE)
def q_diverse_sample(v: Views) -> DataFrame:
    """As many rows of each label, no two of a group."""
    train = v.ligands.filter("split = 'train'").select("ligand_id", "label", "group_id")
    return folds.diverse_sample(train, "ligand_id", "label", "group_id", ("active", "decoy"), 8, 8)


@query("SELECT ligand_id, label FROM (SELECT ligand_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('9|' || ligand_id), ligand_id) AS r FROM ligands) WHERE r <= 10")
def q_random_sample(v: Views) -> DataFrame:
    return folds.random_sample(v.ligands.select("ligand_id", "label"), "ligand_id", "label", 10, 9)


@query("""WITH s AS (SELECT i AS repeat, ligand_id, label, row_number() OVER (PARTITION BY i, label ORDER BY sha256((20 + i) || '|' || ligand_id), ligand_id) AS r, count(*) OVER (PARTITION BY i, label) AS n FROM ligands, range(0, 3) t(i))
SELECT CAST(repeat AS INT) AS repeat, label, CASE WHEN r <= floor(n * 0.6E0) THEN 'train' WHEN r <= floor(n * (0.6E0 + 0.2E0)) THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, sum(ligand_id) AS checksum FROM s GROUP BY ALL""")
def q_repeated_splits(v: Views) -> DataFrame:
    """Splits drawn anew for each repeat, with the repeat as a key."""
    rows = folds.repeated_splits(v.ligands.select("ligand_id", "label"), "ligand_id", "label", 3, 20)
    return rows.groupBy("repeat", "label", "split").agg(F.count(F.lit(1)).alias("rows"), F.sum("ligand_id").alias("checksum"))


# --- geometry ------------------------------------------------------------------------------------------


@query(f"SELECT a, count(*) AS contacts, count(*) FILTER (d <= 0.12) AS clashes, arg_min(b, round(d, 9) * 1000000 + b * 0.0000001) AS closest FROM {NEAR} WHERE d <= 0.25 GROUP BY a")
def q_clash_counts(v: Views) -> DataFrame:
    """Contacts, clashes and the closest partner of each point."""
    return geo.nearest(*near_sides(v, "a", "b"), CUTOFF, clash=0.12).drop("least")


@query("""WITH d AS (SELECT a.cluster_id, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))) AS diameter FROM points a JOIN points b ON a.cluster_id = b.cluster_id GROUP BY 1)
SELECT cluster_id, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(avg(z), 6) AS mean_z, round(max(x) - min(x), 6) AS span_x, round(max(y) - min(y), 6) AS span_y, round(max(z) - min(z), 6) AS span_z,
  round(any_value(diameter), 6) AS diameter, round(any_value(diameter), 6) AS moved_diameter FROM points JOIN d USING (cluster_id) GROUP BY cluster_id""")
def q_geometry_invariants(v: Views) -> DataFrame:
    """Centre, span and largest distance of each cluster, and the latter again after a rigid motion."""
    moved = geo.affine(v.points, ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (2.0, -1.0, 0.5))
    span = lambda c: F.round(F.max(c) - F.min(c), 6).alias(f"span_{c}")
    out = v.points.groupBy("cluster_id").agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in "xyz"], *map(span, "xyz"))
    for df, name in ((v.points, "diameter"), (moved, "moved_diameter")):
        out = out.join(geo.diameters(df, "cluster_id").select("cluster_id", F.round("diameter", 6).alias(name)), "cluster_id")
    return out


@query("""SELECT cluster_id, round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 6) AS volume, round(2 * sum(x * x + y * y + z * z) / 2 / (3 * count(*) * 0.00831446261815324E0), 4) AS temperature
  FROM points GROUP BY cluster_id""")
def q_volume_temperature(v: Views) -> DataFrame:
    """A box's volume, and the temperature of velocities by their kinetic energy."""
    energy = F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) / 2
    span = lambda c: F.max(c) - F.min(c)
    return v.points.groupBy("cluster_id").agg(
        F.round(span("x") * span("y") * span("z"), 6).alias("volume"), F.round(geo.temperature(energy, 3 * F.count(F.lit(1))), 4).alias("temperature")
    )


# --- resumption ---------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY ligand_id) - 1) / 64) AS BIGINT) AS chunk FROM ligands),
s AS (SELECT chunk, sha256('dock|' || string_agg(ligand_id || ':' || label, ',' ORDER BY ligand_id)) AS signature, sha256('dock|' || string_agg(ligand_id || ':' || CASE WHEN heavy_atoms <= 10 AND group_id <> 'Brand#13' THEN 'active' ELSE 'decoy' END, ',' ORDER BY ligand_id)) AS old,
  min(ligand_id) AS lo FROM c GROUP BY chunk) SELECT chunk, signature, signature <> old OR chunk % 8 = 7 AS pending FROM s""")
def q_chunk_signatures(v: Views) -> DataFrame:
    """Chunks of 64 by what they were made of. An earlier run, under another label rule and without each eighth chunk, left its signatures in a file; chunks without their own signature there run again."""
    older = v.ligands.withColumn("label", F.when((F.col("heavy_atoms") <= 10) & (F.col("group_id") != "Brand#13"), "active").otherwise("decoy"))
    folder = resume.scratch(v.spark, "signatures")
    resume.chunk_signatures(older, "ligand_id", "label", 64, "dock").filter("chunk % 8 <> 7").write.parquet(folder)
    stored = v.spark.read.parquet(folder).select("chunk", F.col("signature").alias("stored"))
    now = resume.chunk_signatures(v.ligands, "ligand_id", "label", 64, "dock").join(stored, "chunk", "left")
    return now.select("chunk", "signature", (~F.col("signature").eqNullSafe(F.col("stored"))).alias("pending"))

"""Queries: aggregations, windows, top-k and normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators import aggregate as agg
from orrery.operators import normalize as norm
from orrery.operators import ranking
from orrery.operators import relational as rel
from orrery.plans.q_core import DOUBLES, metric_sql, rounded
from orrery.plans.registry import query
from orrery.plans.views import SEEDS, Views



def _doubles(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers with nulls as doubles, which every client reads alike."""
    return df.withColumns({c: F.col(c).cast("double") for c in names})


REPRESENTATIVE = """SELECT ligand_id, receptor_id, {score} AS representative_score, CASE WHEN n > 0 THEN 'ok' ELSE 'failed' END AS status, n AS pose_count,
  CAST({rank} AS DOUBLE) AS best_pose_rank, best AS best_docking_score FROM (SELECT ligand_id, receptor_id, count(*) FILTER (status = 'ok') AS n,
  min(docking_score) FILTER (status = 'ok') AS best, min(docking_score) FILTER (status = 'ok' AND pose_rank = 1) AS first,
  arg_min(pose_rank, docking_score * 100000 + pose_rank) FILTER (status = 'ok') AS best_rank FROM poses GROUP BY ligand_id, receptor_id)"""


@query(REPRESENTATIVE.format(score="coalesce(first, best)", rank="CASE WHEN first IS NULL THEN best_rank ELSE 1 END"))
def q_representative_rank1(v: Views) -> DataFrame:
    return _doubles(rel.representative(v.poses, ["ligand_id", "receptor_id"]), "best_pose_rank")


@query(REPRESENTATIVE.format(score="best", rank="best_rank"))
def q_representative_min(v: Views) -> DataFrame:
    return _doubles(rel.representative(v.poses, ["ligand_id", "receptor_id"], "min_score"), "best_pose_rank")


@query("""SELECT ligand_id, arg_max(docking_score, o) AS docking_score FROM (SELECT ligand_id, docking_score, receptor_id * 10 + seed AS o FROM poses
  WHERE pose_rank = 1 AND status = 'ok') GROUP BY ligand_id""")
def q_best_pose_last_wins(v: Views) -> DataFrame:
    """First-ranked pose per ligand; of several the last in a stated order counts."""
    first = v.poses.filter("pose_rank = 1 and status = 'ok'")
    return first.groupBy("ligand_id").agg(F.max_by("docking_score", F.struct("receptor_id", "seed")).alias("docking_score"))


@query("SELECT ligand_id, receptor_id, s0, s1, s2, lo, mid, hi, round(hi - lo, 6) AS seed_score_range FROM replicates")
def q_seed_aggregate(v: Views) -> DataFrame:
    out = rel.seed_aggregate(v.seed_scores, ["ligand_id", "receptor_id"], "seed", SEEDS, "score")
    return out.withColumn("seed_score_range", F.round(F.col("hi") - F.col("lo"), 6))


@query("""SELECT ligand_id, receptor_id, lo AS minimum_score, mid AS median_score, hi AS maximum_score, fav AS favorable_replicate_count, n AS replicate_count, best AS best_replicate_id,
  round(hi - lo, 6) AS seed_range, round(mid - lo, 6) AS minimum_median_delta, r AS reasons, r <> '' AS warning FROM (SELECT *, concat_ws(';',
  CASE WHEN hi - lo > 50 THEN 'seed_range_exceeded' END, CASE WHEN mid - lo > 50 THEN 'minimum_median_delta_exceeded' END,
  CASE WHEN fav < 2 THEN 'insufficient_favorable_replicates' END, CASE WHEN lo >= 0 THEN 'nonnegative_minimum_score' END) AS r FROM (
  SELECT ligand_id, receptor_id, min(score) AS lo, median(score) AS mid, max(score) AS hi, count(*) FILTER (score < 0) AS fav, count(*) AS n,
  arg_min(seed, score * 100 + seed * 1.0E-6) AS best FROM seed_scores GROUP BY ligand_id, receptor_id))""")
def q_seed_stability(v: Views) -> DataFrame:
    return agg.seed_stability(v.seed_scores, ["ligand_id", "receptor_id"], "seed", "score", 50, 50, 2)


@query("""SELECT ligand_id, receptor_id, CAST(count(*) FILTER (score <= m + 50) AS INT) AS consensus_replicate_count, round(max(score) - min(score), 6) AS score_range
  FROM (SELECT *, min(score) OVER (PARTITION BY ligand_id, receptor_id) AS m FROM seed_scores) GROUP BY ligand_id, receptor_id""")
def q_consensus_count(v: Views) -> DataFrame:
    return rounded(agg.consensus_count(v.seed_scores, ["ligand_id", "receptor_id"], "score", 50.0), "score_range")


@query("SELECT label, count(*) AS n FROM ligands GROUP BY label")
def q_label_counts(v: Views) -> DataFrame:
    return v.ligands.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT split, count(*) FILTER (label = 'active') AS active, count(*) FILTER (label = 'decoy') AS decoy FROM ligands GROUP BY split")
def q_split_label_counts(v: Views) -> DataFrame:
    counts = v.ligands.groupBy("split").pivot("label", ["active", "decoy"]).count()
    return counts.na.fill(0, ["active", "decoy"])


@query("SELECT r_regionkey AS receptor_id, (SELECT count(*) FROM ligands) - (SELECT count(*) FROM pair_scores WHERE receptor_id = r_regionkey) AS missing FROM region")
def q_missing_by_receptor(v: Views) -> DataFrame:
    grid = rel.expected_grid(v.ligands.select("ligand_id"), v.table("region").select(F.col("r_regionkey").alias("receptor_id")))
    have = v.pair_scores.select("ligand_id", "receptor_id", F.lit(1).alias("have"))
    return grid.join(have, ["ligand_id", "receptor_id"], "left").groupBy("receptor_id").agg(F.count_if(F.col("have").isNull()).alias("missing"))


@query("SELECT count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_duplicates, max(n) AS max_multiplicity FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def q_duplicate_audit(v: Views) -> DataFrame:
    return rel.duplicate_audit(v.table("lineitem", "l_orderkey"), "l_orderkey")


@query("SELECT group_id, ligand_id, heavy_atoms FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ligand_id) AS n FROM ligands) WHERE n = 1")
def q_distinct_first(v: Views) -> DataFrame:
    return rel.distinct_first(v.ligands, "group_id", ["ligand_id"]).select("group_id", "ligand_id", "heavy_atoms")


@query("SELECT label, count(DISTINCT group_id) AS groups, count(DISTINCT source_id) AS sources, count(DISTINCT ligand_id) AS ligands FROM ligands GROUP BY label")
def q_count_distinct(v: Views) -> DataFrame:
    return v.ligands.groupBy("label").agg(
        F.count_distinct("group_id").alias("groups"), F.count_distinct("source_id").alias("sources"), F.count_distinct("ligand_id").alias("ligands")
    )


@query("SELECT receptor_id, count(*) AS best_count FROM (SELECT ligand_id, receptor_id, row_number() OVER (PARTITION BY ligand_id ORDER BY score, receptor_id) AS n FROM scores) WHERE n = 1 GROUP BY receptor_id")
def q_best_receptor_counts(v: Views) -> DataFrame:
    best = v.scores.groupBy("ligand_id").agg(F.min_by("receptor_id", F.struct("score", "receptor_id")).alias("receptor_id"))
    return best.groupBy("receptor_id").agg(F.count(F.lit(1)).alias("best_count"))


@query("SELECT ligand_id, label, least(r0, r2, r4) AS score FROM wide")
def q_ensemble_min(v: Views) -> DataFrame:
    chosen = v.scores.filter(F.col("receptor_id").isin(0, 2, 4))
    return agg.ensemble(chosen, ["ligand_id", "label"], "min_score")


@query("SELECT ligand_id, label, round((r0 + r2 + r4) / 3, 6) AS score FROM wide")
def q_ensemble_mean(v: Views) -> DataFrame:
    chosen = v.scores.filter(F.col("receptor_id").isin(0, 2, 4))
    return rounded(agg.ensemble(chosen, ["ligand_id", "label"], "mean_score"), "score")


@query("SELECT receptor_id, min(score) AS lower, max(score) AS upper FROM scores GROUP BY receptor_id")
def q_score_bounds(v: Views) -> DataFrame:
    return norm.bounds(v.scores, ["receptor_id"])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS population_std, min(value) AS minimum, max(value) AS maximum, count(*) FILTER (value > 0) AS positive_count FROM events GROUP BY event_type")
def q_summary_stats(v: Views) -> DataFrame:
    return rounded(v.table("events", "event_type", "value").groupBy("event_type").agg(*agg.summary("value")), "mean", "population_std")


@query("SELECT receptor_id, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.95), 6) AS p95 FROM scores GROUP BY receptor_id")
def q_percentile_linear(v: Views) -> DataFrame:
    out = v.scores.groupBy("receptor_id").agg(F.percentile("score", 0.25).alias("p25"), F.percentile("score", 0.95).alias("p95"))
    return rounded(out, "p25", "p95")


@query("SELECT receptor_id, max(score) FILTER (r = greatest(1, ceil(0.95E0 * n))) AS p95 FROM (SELECT receptor_id, score, row_number() OVER (PARTITION BY receptor_id ORDER BY score) AS r, count(*) OVER (PARTITION BY receptor_id) AS n FROM scores) GROUP BY receptor_id")
def q_percentile_nearest(v: Views) -> DataFrame:
    return v.scores.groupBy("receptor_id").agg(agg.nearest_rank("score", 0.95).alias("p95"))


@query("SELECT receptor_id, round(avg(CASE WHEN score <= t THEN 1.0E0 ELSE 0.0E0 END), 6) AS share FROM scores, (SELECT avg(score) AS t FROM scores) GROUP BY receptor_id")
def q_ecdf(v: Views) -> DataFrame:
    target = v.scores.agg(F.avg("score").alias("t"))
    return rounded(v.scores.crossJoin(target).groupBy("receptor_id").agg(agg.ecdf("score", "t").alias("share")), "share")


@query("SELECT receptor_id, min(score) AS min, round(quantile_cont(score, 0.05), 6) AS q05, round(median(score), 6) AS median, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS population_std, round(quantile_cont(score, 0.95), 6) AS q95, max(score) AS max FROM scores GROUP BY receptor_id")
def q_distribution_summary(v: Views) -> DataFrame:
    return rounded(v.scores.groupBy("receptor_id").agg(*agg.distribution("score")), "q05", "median", "mean", "population_std", "q95")


@query("SELECT run_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sample_std, min(value) AS minimum, max(value) AS maximum, arg_max(value, frame) AS final FROM frames WHERE isfinite(value) GROUP BY run_id")
def q_finite_summary(v: Views) -> DataFrame:
    finite = v.frames.filter(~F.isnan("value") & (F.abs("value") < float("inf")))
    out = finite.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("value")).alias("sample_std"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.max_by("value", "frame").alias("final"),
    )
    return rounded(out, "mean", "sample_std")


@query("SELECT receptor_id, round(avg(score) FILTER (label = 'active'), 6) AS active_mean, round(avg(score) FILTER (label = 'decoy'), 6) AS decoy_mean, round(avg(score) FILTER (label = 'active') - avg(score) FILTER (label = 'decoy'), 6) AS gap FROM scores GROUP BY receptor_id")
def q_label_mean_gap(v: Views) -> DataFrame:
    of = lambda x: F.avg(F.when(F.col("label") == x, F.col("score")))
    out = v.scores.groupBy("receptor_id").agg(of("active").alias("active_mean"), of("decoy").alias("decoy_mean"), (of("active") - of("decoy")).alias("gap"))
    return rounded(out, "active_mean", "decoy_mean", "gap")


BEST = """b AS (SELECT ligand_id, seed, first(receptor_id ORDER BY score, receptor_id) AS best FROM seed_scores GROUP BY ligand_id, seed),
a AS (SELECT x.seed AS seed_a, y.seed AS seed_b, x.best = y.best AS same FROM b x JOIN b y ON x.ligand_id = y.ligand_id AND x.seed < y.seed)"""


@query(f"WITH {BEST} SELECT CAST(seed_a AS DOUBLE) AS seed_a, CAST(seed_b AS DOUBLE) AS seed_b, round(avg(CASE WHEN same THEN 1.0E0 ELSE 0.0E0 END), 6) AS agreement, count(*) AS n FROM a GROUP BY ROLLUP ((a.seed_a, a.seed_b))")
def q_best_agreement(v: Views) -> DataFrame:
    """How often two replicates choose the same best receptor: per pair of replicates, and over all."""
    b = v.seed_scores.groupBy("ligand_id", "seed").agg(F.min_by("receptor_id", F.struct("score", "receptor_id")).alias("best"))
    x, y = b.select("ligand_id", F.col("seed").alias("seed_a"), F.col("best").alias("p")), b.select("ligand_id", F.col("seed").alias("seed_b"), F.col("best").alias("q"))
    same = x.join(y, "ligand_id").filter("seed_a < seed_b").select("seed_a", "seed_b", (F.col("p") == F.col("q")).cast("double").alias("same"))
    sets = same.groupingSets([[F.col("seed_a"), F.col("seed_b")], []], "seed_a", "seed_b")
    out = rounded(sets.agg(F.avg("same").alias("agreement"), F.count(F.lit(1)).alias("n")), "agreement")
    return _doubles(out, "seed_a", "seed_b")


@query("SELECT ligand_id, receptor_id, round(avg(score), 6) AS mean_score, count(*) AS repeats, count(DISTINCT seed) = 3 AS complete FROM seed_scores GROUP BY ligand_id, receptor_id")
def q_repeat_mean(v: Views) -> DataFrame:
    out = v.seed_scores.groupBy("ligand_id", "receptor_id").agg(
        F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("repeats"), (F.count_distinct("seed") == 3).alias("complete")
    )
    return rounded(out, "mean_score")


SUBSETS = """t AS (SELECT split, list(receptor_id ORDER BY m, receptor_id)[1:3] AS subset FROM (SELECT split, receptor_id, avg(score) AS m FROM scores GROUP BY split, receptor_id) GROUP BY split)"""


def chosen_subsets(v: Views) -> DataFrame:
    """Three receptors per split, by mean score."""
    means = v.scores.groupBy("split", "receptor_id").agg(F.avg("score").alias("m"))
    order = F.array_sort(F.collect_list(F.struct("m", "receptor_id")))
    return means.groupBy("split").agg(F.slice(F.transform(order, lambda x: x["receptor_id"]), 1, 3).alias("subset"))


@query(f"WITH {SUBSETS} SELECT r AS receptor_id, count(*) AS n, round(count(*) * 1.0E0 / (SELECT count(*) FROM t), 6) AS frequency FROM (SELECT unnest(subset) AS r FROM t) GROUP BY r")
def q_inclusion_frequency(v: Views) -> DataFrame:
    from orrery.operators.subsets import inclusion_frequency

    return rounded(inclusion_frequency(chosen_subsets(v), "subset").withColumnRenamed("member", "receptor_id"), "frequency")


@query("""SELECT receptor_id, count(*) AS pair_count, round(avg(g), 6) AS mean_range, round(median(g), 6) AS median_range, round(max(g) FILTER (r = greatest(1, ceil(0.95E0 * n))), 6) AS p95_range,
  round(max(g), 6) AS max_range, count(*) FILTER (g > 0.5) AS above_half, count(*) FILTER (g > 1) AS above_one FROM (
  SELECT receptor_id, hi - lo AS g, row_number() OVER (PARTITION BY receptor_id ORDER BY hi - lo) AS r, count(*) OVER (PARTITION BY receptor_id) AS n FROM replicates) GROUP BY receptor_id""")
def q_receptor_uncertainty(v: Views) -> DataFrame:
    out = v.replicates.withColumn("g", F.col("hi") - F.col("lo")).groupBy("receptor_id").agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.avg("g").alias("mean_range"),
        F.median("g").alias("median_range"),
        agg.nearest_rank("g", 0.95).alias("p95_range"),
        F.max("g").alias("max_range"),
        F.count_if(F.col("g") > 0.5).alias("above_half"),
        F.count_if(F.col("g") > 1).alias("above_one"),
    )
    return rounded(out, "mean_range", "median_range", "p95_range", "max_range")


@query(metric_sql("matrix_id, receptor_id", "matrices", "matrix_id, receptor_id, ligand_count, bedroc"))
def q_matrix_metrics(v: Views) -> DataFrame:
    return rounded(ranking.metrics(v.matrices, ["matrix_id", "receptor_id"]).select("matrix_id", "receptor_id", "ligand_count", "bedroc"), "bedroc")


ROBUST = """receptor_id, max(CASE WHEN matrix_id = 'primary' THEN bedroc END) AS primary_value, max(CASE WHEN matrix_id = 'sensitivity' THEN bedroc END) AS sensitivity_value,
  round(avg(CASE WHEN matrix_id LIKE 'seed%' THEN bedroc END), 5) AS mean_seed, min(CASE WHEN matrix_id LIKE 'seed%' THEN bedroc END) AS worst_seed"""


@query(metric_sql("matrix_id, receptor_id", "matrices", ROBUST) + " GROUP BY receptor_id")
def q_robust_summary(v: Views) -> DataFrame:
    m = q_matrix_metrics(v)
    seed = F.when(F.col("matrix_id").startswith("seed"), F.col("bedroc"))
    of = lambda x: F.max(F.when(F.col("matrix_id") == x, F.col("bedroc")))
    return m.groupBy("receptor_id").agg(
        of("primary").alias("primary_value"), of("sensitivity").alias("sensitivity_value"), F.round(F.avg(seed), 5).alias("mean_seed"), F.min(seed).alias("worst_seed")
    )


@query("""SELECT ligand_id, receptor_id, count(*) AS runs, round(avg(docking_score) FILTER (seed = 0), 6) AS mean_0, round(max(docking_score) FILTER (seed = 0) - min(docking_score) FILTER (seed = 0), 6) AS range_0,
  round(avg(docking_score) FILTER (seed = 1), 6) AS mean_1, round(max(docking_score) FILTER (seed = 1) - min(docking_score) FILTER (seed = 1), 6) AS range_1,
  round(abs(avg(docking_score) FILTER (seed = 0) - avg(docking_score) FILTER (seed = 1)), 6) AS protocol_delta FROM poses WHERE status = 'ok' GROUP BY ligand_id, receptor_id""")
def q_protocol_ladder(v: Views) -> DataFrame:
    at = lambda s: F.when(F.col("seed") == s, F.col("docking_score"))
    cells = []
    for s in (0, 1):
        cells += [F.round(F.avg(at(s)), 6).alias(f"mean_{s}"), F.round(F.max(at(s)) - F.min(at(s)), 6).alias(f"range_{s}")]
    delta = F.round(F.abs(F.avg(at(0)) - F.avg(at(1))), 6).alias("protocol_delta")
    return v.poses.filter("status = 'ok'").groupBy("ligand_id", "receptor_id").agg(F.count(F.lit(1)).alias("runs"), *cells, delta)


@query("SELECT ligand_id, receptor_id, round(abs(mid - lo), 6) AS median_delta, abs(mid - lo) <= 100 AND hi - lo <= 200 AS rescued FROM replicates")
def q_rescue_test(v: Views) -> DataFrame:
    delta, spread = F.abs(F.col("mid") - F.col("lo")), F.col("hi") - F.col("lo")
    return v.replicates.select("ligand_id", "receptor_id", F.round(delta, 6).alias("median_delta"), ((delta <= 100) & (spread <= 200)).alias("rescued"))


# --- windows -----------------------------------------------------------------------------------


@query("SELECT ligand_id, receptor_id, round(score - median(score) OVER (PARTITION BY ligand_id), 6) AS delta FROM scores")
def q_delta_from_median(v: Views) -> DataFrame:
    m = F.median("score").over(Window.partitionBy("ligand_id"))
    return v.scores.select("ligand_id", "receptor_id", F.round(F.col("score") - m, 6).alias("delta"))


@query("""SELECT run_id, cluster_id, CAST(sum(n) AS BIGINT) AS size, min(a) AS first_frame, max(b) AS last_frame, count(*) AS run_count, max(n) AS longest_run, count(*) > 1 AS revisited FROM (
  SELECT run_id, cluster_id, min(frame) AS a, max(frame) AS b, count(*) AS n FROM (SELECT *, frame - row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY frame) AS g FROM frames)
  GROUP BY run_id, cluster_id, g) GROUP BY run_id, cluster_id""")
def q_temporal_runs(v: Views) -> DataFrame:
    return agg.temporal_runs(v.frames, "run_id", "frame", "cluster_id")


@query("""SELECT run_id, count(*) AS frames, round(avg(value), 6) AS mean, arg_min(value, frame) AS first, arg_max(value, frame) AS final, round(regr_slope(value, frame), 6) AS slope FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame DESC) AS n FROM frames) WHERE n <= 20 GROUP BY run_id""")
def q_late_window_trend(v: Views) -> DataFrame:
    return rounded(agg.late_window(v.frames, "run_id", "frame", "value", 20), "mean", "slope")


@query("SELECT ligand_id, CAST(floor((row_number() OVER (PARTITION BY label ORDER BY ligand_id) - 1) / 8) AS BIGINT) AS chunk, 1000 + row_number() OVER (PARTITION BY label ORDER BY ligand_id) AS seed, CAST((row_number() OVER (PARTITION BY label ORDER BY ligand_id) - 1) % 5 AS INT) AS fold FROM ligands")
def q_chunking(v: Views) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("label").orderBy("ligand_id"))
    return v.ligands.select("ligand_id", F.floor((n - 1) / 8).alias("chunk"), (n + 1000).cast("long").alias("seed"), ((n - 1) % 5).cast("int").alias("fold"))


# --- top-k ---------------------------------------------------------------------------------------


@query(metric_sql("split, receptor_id", "scores", "split, first(receptor_id ORDER BY bedroc DESC, roc_auc DESC, receptor_id) AS receptor_id") + " GROUP BY split")
def q_best_candidate(v: Views) -> DataFrame:
    m = rounded(ranking.metrics(v.scores, ["split", "receptor_id"]), *DOUBLES)
    key = F.struct(-F.col("bedroc"), -F.col("roc_auc"), F.col("receptor_id"))
    return m.groupBy("split").agg(F.min_by("receptor_id", key).alias("receptor_id"))


@query(metric_sql("receptor_id", "scores", "CAST(row_number() OVER (ORDER BY bedroc DESC, receptor_id) AS INT) AS rank, receptor_id, bedroc, row_number() OVER (ORDER BY bedroc DESC, receptor_id) = 1 AS selected"))
def q_rank_receptors(v: Views) -> DataFrame:
    m = rounded(ranking.metrics(v.scores, ["receptor_id"]), "bedroc")
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("bedroc"), "receptor_id"))
    return m.select(rank.alias("rank"), "receptor_id", "bedroc").withColumn("selected", F.col("rank") == 1)


@query("SELECT ligand_id, receptor_id, round(abs(s0 - s1), 6) AS delta FROM replicates ORDER BY delta DESC, ligand_id, receptor_id LIMIT 25")
def q_worst_pairs(v: Views) -> DataFrame:
    d = v.replicates.select("ligand_id", "receptor_id", F.round(F.abs(F.col("s0") - F.col("s1")), 6).alias("delta"))
    return d.orderBy(F.desc("delta"), "ligand_id", "receptor_id").limit(25)


@query("SELECT array_to_string(list(CAST(receptor_id AS VARCHAR) ORDER BY receptor_id), '+') AS subset FROM (SELECT receptor_id, avg(score) AS c FROM scores GROUP BY receptor_id ORDER BY c, receptor_id LIMIT 3)")
def q_linear_top_k(v: Views) -> DataFrame:
    top = v.scores.groupBy("receptor_id").agg(F.avg("score").alias("c")).orderBy("c", "receptor_id").limit(3)
    return top.agg(F.array_join(F.array_sort(F.collect_list("receptor_id")).cast("array<string>"), "+").alias("subset"))


@query("""SELECT point_id, alt FROM (SELECT point_id, alt, row_number() OVER (PARTITION BY point_id ORDER BY -occ, CASE alt WHEN '' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, alt) AS n FROM (
  SELECT point_id, '' AS alt, round(x, 1) AS occ FROM points UNION ALL SELECT point_id, 'A', round(y, 1) FROM points UNION ALL SELECT point_id, 'B', round(z, 1) FROM points)) WHERE n = 1""")
def q_altloc_select(v: Views) -> DataFrame:
    """One alternate location per atom: highest occupancy, then blank, then A, then by letter."""
    from orrery.operators.geometry import best_altloc

    p = v.points.select("point_id", F.explode(F.array(*[F.struct(F.lit(a).alias("alt"), F.round(c, 1).alias("occ")) for a, c in (("", "x"), ("A", "y"), ("B", "z"))])).alias("l"))
    return best_altloc(p.select("point_id", "l.*"), ["point_id"], "alt", "occ").select("point_id", "alt")


# --- normalisation ----------------------------------------------------------------------------------

TRAIN = "(SELECT receptor_id, min(score) AS lower, max(score) AS upper FROM scores WHERE split = 'train' GROUP BY receptor_id)"


@query(f"SELECT ligand_id, receptor_id, split, round(CASE WHEN upper = lower THEN 0 ELSE (score - lower) / (upper - lower) END, 6) AS normalized FROM scores JOIN {TRAIN} USING (receptor_id)")
def q_train_minmax(v: Views) -> DataFrame:
    frozen = norm.bounds(v.scores.filter("split = 'train'"), ["receptor_id"])
    return rounded(norm.apply_bounds(v.scores, frozen, ["receptor_id"]).select("ligand_id", "receptor_id", "split", "normalized"), "normalized")


@query("""SELECT matrix_id, ligand_id, receptor_id, round(CASE WHEN upper = lower THEN 0 ELSE (score - lower) / (upper - lower) END, 6) AS normalized FROM matrices JOIN (
  SELECT matrix_id, receptor_id, min(score) AS lower, max(score) AS upper FROM matrices WHERE split = 'train' GROUP BY matrix_id, receptor_id) USING (matrix_id, receptor_id) WHERE split <> 'train'""")
def q_frozen_bounds(v: Views) -> DataFrame:
    keys = ["matrix_id", "receptor_id"]
    frozen = norm.bounds(v.matrices.filter("split = 'train'"), keys)
    out = norm.apply_bounds(v.matrices.filter("split <> 'train'"), frozen, keys)
    return rounded(out.select("matrix_id", "ligand_id", "receptor_id", "normalized"), "normalized")


TERMS = "(SELECT receptor_id, avg(score) AS v FROM scores GROUP BY receptor_id)"


def _terms(v: Views) -> DataFrame:
    return v.scores.groupBy("receptor_id").agg(F.avg("score").alias("v")).withColumn("term", F.lit("mean"))


@query(f"SELECT receptor_id, round(CASE WHEN max(v) OVER () = min(v) OVER () THEN 0 ELSE (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) END, 6) AS term, round(CASE WHEN max(v) OVER () = min(v) OVER () THEN 0.5 ELSE (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) END, 6) AS utility FROM {TERMS}")
def q_minmax_terms(v: Views) -> DataFrame:
    t = _terms(v).withColumns({"u": norm.minmax("v", ["term"], 0.5), "t": norm.minmax("v", ["term"])})
    return t.select("receptor_id", F.round("t", 6).alias("term"), F.round("u", 6).alias("utility"))


@query(f"SELECT receptor_id, round(v / max(abs(v)) OVER (), 6) AS scaled FROM {TERMS}")
def q_maxabs_terms(v: Views) -> DataFrame:
    return _terms(v).select("receptor_id", F.round(norm.maxabs("v", ["term"]), 6).alias("scaled"))


LONG = "(SELECT point_id, 'x' AS feature, x AS value FROM points UNION ALL SELECT point_id, 'y', y FROM points UNION ALL SELECT point_id, 'z', z FROM points)"


@query(f"SELECT point_id, feature, round((value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature), 6) AS z FROM {LONG}")
def q_standardize(v: Views) -> DataFrame:
    long = v.points.unpivot(["point_id"], ["x", "y", "z"], "feature", "value")
    return rounded(norm.standardize(long, "feature", "value").select("point_id", "feature", "z"), "z")


@query(f"SELECT point_id, feature, round(coalesce(w, median(w) OVER (PARTITION BY feature)), 6) AS value FROM (SELECT *, CASE WHEN point_id % 7 > 0 THEN value END AS w FROM {LONG})")
def q_median_impute(v: Views) -> DataFrame:
    long = v.points.unpivot(["point_id"], ["x", "y", "z"], "feature", "value")
    holes = long.withColumn("value", F.when(F.col("point_id") % 7 > 0, F.col("value")))
    return rounded(norm.impute_median(holes, "feature", "value").select("point_id", "feature", "value"), "value")

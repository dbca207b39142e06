"""Queries: the flagship, ranking and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators import ranking
from orrery.operators.order import score_piece, spread
from orrery.plans.registry import query
from orrery.plans.views import Views


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Doubles are compared at six places; NaN, which SQL engines treat differently, as null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.round(c, places)) for c in names})


#: Rank metrics per key in SQL; ``{keys}`` and ``{rows}`` (with score, ligand_id, label) are filled in.
METRICS = """
rk AS (SELECT {keys}, score, ligand_id, CASE WHEN label = 'active' THEN 1 ELSE 0 END AS a,
  row_number() OVER (PARTITION BY {keys} ORDER BY score, ligand_id) AS r,
  rank() OVER (PARTITION BY {keys} ORDER BY score DESC) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0E0 AS ar,
  count(*) OVER (PARTITION BY {keys}) AS n FROM {rows}),
rs AS (SELECT *, sum(a) OVER (PARTITION BY {keys} ORDER BY r ROWS UNBOUNDED PRECEDING) AS seen, sum(a) OVER (PARTITION BY {keys}) AS m FROM rk),
me AS (SELECT {keys}, max(n) AS n, max(m) AS m, sum(CASE WHEN a = 1 THEN ar END) AS ranks, sum(CASE WHEN a = 1 THEN seen * 1.0E0 / r END) AS prec,
  sum(CASE WHEN a = 1 THEN exp(-20.0E0 * r / n) END) AS obs, sum(CASE WHEN r <= m THEN exp(-20.0E0 * r / n) END) AS best,
  sum(CASE WHEN r > n - m THEN exp(-20.0E0 * r / n) END) AS worst,
  sum(CASE WHEN r <= greatest(1, ceil(n * 0.01E0)) THEN a END) AS h1, sum(CASE WHEN r <= greatest(1, ceil(n * 0.05E0)) THEN a END) AS h5,
  sum(CASE WHEN r <= greatest(1, ceil(n * 0.1E0)) THEN a END) AS h10, sum(CASE WHEN r <= 10 THEN a ELSE 0 END) AS t10,
  string_agg(CASE WHEN r <= 10 THEN CAST(ligand_id AS VARCHAR) END, ';' ORDER BY r) AS ids FROM rs GROUP BY {keys}),
mx AS (SELECT {keys}, CAST(n AS BIGINT) AS ligand_count, CAST(m AS BIGINT) AS active_count,
  CASE WHEN m > 0 AND m < n THEN round((ranks - m * (m + 1) / 2.0E0) / (m * (n - m)), 6) END AS roc_auc,
  CASE WHEN m > 0 THEN round(prec / m, 6) END AS average_precision,
  CASE WHEN m > 0 AND m < n AND best <> worst THEN round((obs - worst) / (best - worst), 6) END AS bedroc,
  CASE WHEN m > 0 THEN round((h1 / greatest(1, ceil(n * 0.01E0))) / (m * 1.0E0 / n), 6) END AS ef1,
  CASE WHEN m > 0 THEN round((h5 / greatest(1, ceil(n * 0.05E0))) / (m * 1.0E0 / n), 6) END AS ef5,
  CASE WHEN m > 0 THEN round((h10 / greatest(1, ceil(n * 0.1E0))) / (m * 1.0E0 / n), 6) END AS ef10,
  CAST(t10 AS BIGINT) AS top10_active_count, ids AS top10_ids FROM me)
"""
DOUBLES = "roc_auc", "average_precision", "bedroc", "ef1", "ef5", "ef10"


def metric_sql(keys: str, rows: str, select: str = "*", before: str = "") -> str:
    return f"WITH {before}{METRICS.format(keys=keys, rows=rows)} SELECT {select} FROM mx"


@query(metric_sql("receptor_id", "scores"))
def q_metric_bundle(v: Views) -> DataFrame:
    return rounded(ranking.metrics(v.scores, ["receptor_id"]), *DOUBLES)


@query(metric_sql("receptor_id", "scores", "receptor_id, roc_auc"))
def q_roc_auc(v: Views) -> DataFrame:
    return q_metric_bundle(v).select("receptor_id", "roc_auc")


@query(metric_sql("receptor_id", "scores", "receptor_id, average_precision"))
def q_average_precision(v: Views) -> DataFrame:
    return q_metric_bundle(v).select("receptor_id", "average_precision")


@query(metric_sql("receptor_id", "scores", "receptor_id, bedroc"))
def q_bedroc(v: Views) -> DataFrame:
    return q_metric_bundle(v).select("receptor_id", "bedroc")


@query(metric_sql("receptor_id", "scores", "receptor_id, ef1, ef5, ef10"))
def q_enrichment_factor(v: Views) -> DataFrame:
    return q_metric_bundle(v).select("receptor_id", "ef1", "ef5", "ef10")


@query(metric_sql("split, receptor_id", "scores"))
def q_metrics_by_split(v: Views) -> DataFrame:
    return rounded(ranking.metrics(v.scores, ["split", "receptor_id"]), *DOUBLES)


@query("SELECT receptor_id, ligand_id, label, score, CAST(row_number() OVER (PARTITION BY receptor_id ORDER BY score, ligand_id) AS INT) AS rank FROM scores")
def q_ranking(v: Views) -> DataFrame:
    out = ranking.ranked(v.scores, ["receptor_id"])
    return out.select("receptor_id", "ligand_id", "label", "score", F.col("rank").cast("int").alias("rank"))


@query("""SELECT receptor_id, ligand_id, rank() OVER (PARTITION BY receptor_id ORDER BY score)
  + (count(*) OVER (PARTITION BY receptor_id, score) - 1) / 2.0E0 AS average_rank FROM scores""")
def q_average_rank(v: Views) -> DataFrame:
    return ranking.average_rank(v.scores.select("receptor_id", "ligand_id", "score"), ["receptor_id"], "score").drop("score")


@query("""SELECT receptor_id, ligand_id, round(sum(CASE WHEN label = 'active' THEN 1 ELSE 0 END) OVER (PARTITION BY receptor_id
  ORDER BY score, ligand_id ROWS UNBOUNDED PRECEDING) * 1.0E0 / row_number() OVER (PARTITION BY receptor_id ORDER BY score, ligand_id), 6) AS precision_at FROM scores""")
def q_precision_at_rank(v: Views) -> DataFrame:
    active = F.when(F.col("label") == "active", 1).otherwise(0)
    out = spread(v.scores, ["receptor_id"], score_piece("score"), ["score", "ligand_id"], {"a": active})
    return out.select("receptor_id", "ligand_id", F.round(F.col("__to_a") / F.col("__to_n"), 6).alias("precision_at"))


@query("""SELECT receptor_id, ligand_id, r AS rank FROM (SELECT receptor_id, ligand_id,
  CAST(row_number() OVER (PARTITION BY receptor_id ORDER BY score, ligand_id) AS INT) AS r FROM scores) WHERE r <= 10""")
def q_top10(v: Views) -> DataFrame:
    return ranking.best(v.scores, ["receptor_id"], 10).select("receptor_id", "ligand_id", "rank")


TOP = """SELECT receptor_id, ligand_id, label FROM (SELECT *, row_number() OVER (PARTITION BY receptor_id ORDER BY score, ligand_id) AS r,
  count(*) OVER (PARTITION BY receptor_id) AS n FROM scores) WHERE """


def _with_count(v: Views) -> DataFrame:
    return ranking.ranked(v.scores, ["receptor_id"], n="n")


@query(TOP + "r <= greatest(1, ceil(n * 0.07E0)) AND label = 'active'")
def q_top_fraction_active(v: Views) -> DataFrame:
    top = _with_count(v).filter(F.col("rank") <= ranking.top_count(F.col("n"), 0.07))
    return top.filter("label = 'active'").select("receptor_id", "ligand_id", "label")


@query(TOP + "r <= greatest(1, CAST(floor(n * 0.07E0 + 0.999999E0) AS BIGINT))")
def q_top_fraction_label(v: Views) -> DataFrame:
    """The other rounding rule: n times the fraction, plus almost one, cut off."""
    k = F.greatest(F.lit(1), F.floor(F.col("n") * 0.07 + 0.999999))
    return _with_count(v).filter(F.col("rank") <= k).select("receptor_id", "ligand_id", "label")


def _seed_pairs(v: Views) -> DataFrame:
    """Seeds 0 and 1 as two engines that scored the same pairs."""
    return v.replicates.select("receptor_id", "ligand_id", F.col("s0").alias("a"), F.col("s1").alias("b"))


PEARSON = """SELECT receptor_id, count(*) AS pair_count, CASE WHEN max(a) = min(a) OR max(b) = min(b) THEN
  CASE WHEN max(abs(a - b)) = 0 THEN 1.0E0 ELSE 0.0E0 END ELSE round(corr(a, b), 6) END AS r FROM {} GROUP BY receptor_id"""


@query(PEARSON.format("(SELECT receptor_id, s0 AS a, s1 AS b FROM replicates)"))
def q_pearson(v: Views) -> DataFrame:
    return rounded(ranking.pearson(_seed_pairs(v), ["receptor_id"], "a", "b"), "r")


@query(PEARSON.format("""(SELECT receptor_id, rank() OVER (PARTITION BY receptor_id ORDER BY s0) + (count(*) OVER (PARTITION BY receptor_id, s0) - 1) / 2.0E0 AS a,
  rank() OVER (PARTITION BY receptor_id ORDER BY s1) + (count(*) OVER (PARTITION BY receptor_id, s1) - 1) / 2.0E0 AS b FROM replicates)"""))
def q_spearman(v: Views) -> DataFrame:
    return rounded(ranking.spearman(_seed_pairs(v), ["receptor_id"], "a", "b"), "r")


@query("""SELECT receptor_id, sum(CASE WHEN i <= 10 AND j <= 10 THEN 1 ELSE 0 END) AS shared, least(count(*), 10) AS top_n,
  round(sum(CASE WHEN i <= 10 AND j <= 10 THEN 1 ELSE 0 END) * 1.0E0 / least(count(*), 10), 6) AS overlap FROM (
  SELECT receptor_id, row_number() OVER (PARTITION BY receptor_id ORDER BY s0, ligand_id) AS i,
  row_number() OVER (PARTITION BY receptor_id ORDER BY s1, ligand_id) AS j FROM replicates) GROUP BY receptor_id""")
def q_top_overlap(v: Views) -> DataFrame:
    return rounded(ranking.top_overlap(_seed_pairs(v), ["receptor_id"], "a", "b", 10), "overlap")


@query("""WITH d AS (SELECT receptor_id, ligand_id, s1 - s0 AS d, s0, s1 FROM replicates)
SELECT receptor_id, count(*) AS pair_count, round(avg(d), 6) AS mean_delta, round(median(d), 6) AS median_delta,
  round(quantile_cont(abs(d), 0.95), 6) AS p95_abs_delta, round(max(abs(d)), 6) AS max_abs_delta FROM d GROUP BY receptor_id""")
def q_engine_group_metrics(v: Views) -> DataFrame:
    d = _seed_pairs(v).withColumn("d", F.col("b") - F.col("a"))
    out = d.groupBy("receptor_id").agg(
        F.count(F.lit(1)).alias("pair_count"),
        F.avg("d").alias("mean_delta"),
        F.median("d").alias("median_delta"),
        F.percentile(F.abs("d"), 0.95).alias("p95_abs_delta"),
        F.max(F.abs("d")).alias("max_abs_delta"),
    )
    return rounded(out, "mean_delta", "median_delta", "p95_abs_delta", "max_abs_delta")


@query("""SELECT CAST(count(*) FILTER (r - p <> 1 OR score < q) AS INT) AS violations, count(*) AS rows FROM (SELECT *, lag(r) OVER (PARTITION BY receptor_id ORDER BY r) AS p,
  lag(score) OVER (PARTITION BY receptor_id ORDER BY r) AS q FROM (SELECT *, row_number() OVER (PARTITION BY receptor_id ORDER BY score, ligand_id) AS r FROM scores))""")
def q_ranking_audit(v: Views) -> DataFrame:
    """Ranks that do not rise by one, or scores that fall along them: there are none."""
    r = ranking.ranked(v.scores, ["receptor_id"])
    order = Window.partitionBy("receptor_id").orderBy("rank")
    bad = (F.col("rank") - F.lag("rank").over(order) != 1) | (F.col("score") < F.lag("score").over(order))
    checked = r.select(bad.alias("bad"))
    return checked.agg(F.count_if("bad").cast("int").alias("violations"), F.count(F.lit(1)).alias("rows"))

"""Queries: nested cross-validation that chooses a family and a subset inside each outer fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators import folds, normalize, ranking
from orrery.operators import objective as obj
from orrery.operators import subsets as sub
from orrery.operators.ranksums import billionths, subset_metrics
from orrery.plans.q_core import DOUBLES, METRICS, rounded
from orrery.plans.q_select import FOLDS, NAME, folded
from orrery.plans.registry import query
from orrery.plans.views import RECEPTORS, Views

SIZES = 2, 3
NESTED = f"""{FOLDS}, nb AS (SELECT o, i, receptor_id, min(score) AS lower, max(score) AS upper FROM fo, range(0, 5) t(o), range(0, 5) u(i) WHERE fold <> o AND fold <> i GROUP BY o, i, receptor_id),
nn AS (SELECT o, i, fo.receptor_id, ligand_id, label, CASE WHEN upper = lower THEN 0 ELSE round((score - lower) / (upper - lower), 9) END AS score FROM fo JOIN nb ON nb.i = fo.fold AND nb.receptor_id = fo.receptor_id),
nm AS (SELECT o, i, mask, ligand_id, label, min(score) AS low, round(avg(score), 9) AS middle FROM nn JOIN range(1, 32) t(mask) ON (mask >> receptor_id) & 1 = 1 AND bit_count(mask) IN (2, 3) GROUP BY ALL),
ns AS (SELECT o, i, 'min' AS how, mask, ligand_id, label, low AS score FROM nm UNION ALL SELECT o, i, 'mean', mask, ligand_id, label, middle FROM nm),
nk AS (SELECT * FROM (WITH {METRICS.format(keys="o, i, how, mask", rows="ns")} SELECT * FROM mx)),
cd AS (SELECT o, how, mask, round(avg(bedroc) FILTER (i <> o), 8) AS inner_mean, round(stddev_pop(bedroc) FILTER (i <> o), 6) AS inner_spread, max(bedroc) FILTER (i = o) AS outer_bedroc FROM nk GROUP BY o, how, mask),
fa AS (SELECT *, row_number() OVER (PARTITION BY o, how, bit_count(mask) ORDER BY inner_mean DESC NULLS LAST, inner_spread, mask) AS nth FROM cd),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY inner_mean DESC NULLS LAST, bit_count(mask), how) AS best FROM fa WHERE nth = 1) WHERE best = 1)"""


def nested_rows(v: Views) -> DataFrame:
    """Each row once per outer fold, ``o``, its own fold being ``i``; scaled by the bounds of all folds but these two.

    Where ``i`` is ``o`` the row is the outer fold's test, else it validates inside.
    """
    placed = folds.checkpointed(folded(v))
    bounds = F.broadcast(folds.nested_bounds(placed, 5, ["receptor_id"]))  # a row for each scorer and two folds
    scaled = normalize.apply_bounds(folds.nested_roles(placed, 5), bounds, ["o", "i", "receptor_id"])
    return folds.checkpointed(scaled.select("o", "i", "receptor_id", "ligand_id", "label", F.round("normalized", 9).alias("score")))


def nested_metrics(v: Views, rows: DataFrame) -> DataFrame:
    found = subset_metrics(rows.withColumn("score", billionths("score")), sub.k_subsets(v.spark, RECEPTORS, SIZES), RECEPTORS, ["o", "i"], whole=True)
    return folds.checkpointed(rounded(found, *DOUBLES))


def nested_choice(found: DataFrame) -> DataFrame:
    """Per outer fold the best family (aggregation and size), by its best subset's mean over the inner folds."""
    inside = F.when(F.col("i") != F.col("o"), F.col("bedroc"))
    cands = found.groupBy("o", "how", "mask").agg(
        F.round(F.avg(inside), 8).alias("inner_mean"),
        F.round(F.stddev_pop(inside), 6).alias("inner_spread"),
        F.max(F.when(F.col("i") == F.col("o"), F.col("bedroc"))).alias("outer_bedroc"),
    )
    size = F.bit_count("mask")
    in_family = Window.partitionBy("o", "how", size).orderBy(F.desc("inner_mean"), F.asc_nulls_last("inner_spread"), "mask")
    best = cands.withColumn("nth", F.row_number().over(in_family)).filter("nth = 1").drop("nth")
    first = F.row_number().over(Window.partitionBy("o").orderBy(F.desc("inner_mean"), size, "how"))
    return best.withColumn("best", first).filter("best = 1").drop("best")


@query(f"WITH {NESTED} SELECT CAST(o AS INT) AS outer_fold, how, {NAME} AS subset, inner_mean, inner_spread, outer_bedroc FROM ch")
def q_nested_cv(v: Views) -> DataFrame:
    """What each outer fold chose on its inner folds alone, and how that did on the fold held out."""
    found = nested_metrics(v, nested_rows(v))
    out = nested_choice(found).join(F.broadcast(sub.k_subsets(v.spark, RECEPTORS, SIZES)), "mask")  # a row per subset
    return out.select(F.col("o").alias("outer_fold"), "how", sub.subset_name("subset").alias("subset"), "inner_mean", "inner_spread", "outer_bedroc")


@query(f"""WITH {NESTED}, oof AS (SELECT 0 AS pool, ligand_id, label, score FROM ns JOIN ch ON ch.o = ns.o AND ch.how = ns.how AND ch.mask = ns.mask WHERE ns.i = ns.o),
  pooled AS (SELECT * FROM (WITH {METRICS.format(keys="pool", rows="oof")} SELECT * FROM mx)) SELECT ligand_count, active_count, roc_auc, average_precision, bedroc FROM pooled""")
def q_nested_oof(v: Views) -> DataFrame:
    """Held-out scores of what each outer fold chose, pooled and ranked together."""
    rows = nested_rows(v)
    chosen = folds.checkpointed(nested_choice(nested_metrics(v, rows)).select("o", "how", "mask"))
    kept = sub.k_subsets(v.spark, RECEPTORS, SIZES).join(F.broadcast(chosen.select("mask").distinct()), "mask", "left_semi")
    scores = obj.ensemble_scores(rows.filter("i = o"), kept, ["o"])
    held_out = scores.join(F.broadcast(chosen), ["o", "how", "mask"]).withColumn("pool", F.lit(0))  # a row per outer fold
    out = rounded(ranking.metrics(held_out, ["pool"]), *DOUBLES)
    return out.select("ligand_count", "active_count", "roc_auc", "average_precision", "bedroc")

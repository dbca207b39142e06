"""Queries: an independent audit of stored held-out scores, bundles with other parameters, step schedules and intake counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import units
from orrery.operators import audit, ranking
from orrery.operators.order import score_piece, spread
from orrery.plans.q_core import METRICS, rounded
from orrery.plans.q_families import FAMILY_SQL, Nested
from orrery.plans.registry import query
from orrery.plans.views import Views
from orrery.streaming import resume


def second_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, second_auc, second_precision``: the area as a sum over score thresholds and the mean precision at actives, written anew from ranks."""
    at = df.groupBy(*keys, "score").agg(F.count_if(F.col("label") == "active").alias("a"), F.count_if(F.col("label") != "active").alias("d"))
    at = spread(at, keys, score_piece("score"), ["score"], {"a": F.col("a"), "d": F.col("d")})
    area = F.sum(F.col("d") * (F.col("__to_a") - F.col("a") / 2.0)) / F.max("__all_a") / F.max("__all_d")
    one = at.groupBy(*keys).agg(area.alias("second_auc"))
    hit = F.when(F.col("label") == "active", 1).otherwise(0)
    rows = spread(df, keys, score_piece("score"), ["score", "ligand_id"], {"hit": hit}).withColumn("hit", hit)
    two = rows.groupBy(*keys).agg((F.sum(F.col("hit") * F.col("__to_hit") / F.col("__to_n")) / F.sum("hit")).alias("second_precision"))
    return one.join(two, keys)


@query(f"""WITH {FAMILY_SQL}, ax AS (SELECT family, count(*) AS rows, count(DISTINCT ligand_id) AS ids FROM oo GROUP BY family),
s9 AS (SELECT family, score, count(*) FILTER (label = 'active') AS ac, count(*) FILTER (label <> 'active') AS de FROM oo GROUP BY ALL), u9 AS (SELECT *, sum(ac) OVER (PARTITION BY family ORDER BY score) AS up FROM s9),
au AS (SELECT family, sum(de * (up - ac / 2.0E0)) / sum(ac) / sum(de) AS auc FROM u9 GROUP BY family),
pr AS (SELECT family, avg(seen * 1.0E0 / r) FILTER (label = 'active') AS ap FROM (SELECT *, count(*) FILTER (label = 'active') OVER (PARTITION BY family ORDER BY r) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score, ligand_id) AS r FROM oo)) GROUP BY family),
ld AS (SELECT family, count(*) FILTER (l.label IS DISTINCT FROM oo.label) AS label_differs FROM oo LEFT JOIN ligands l ON l.ligand_id = oo.ligand_id GROUP BY family),
lk AS (SELECT count(*) AS crossing FROM (SELECT group_id FROM fo GROUP BY group_id HAVING count(DISTINCT fold) > 1))
SELECT family, rows - ids AS repeated_ids, (SELECT count(DISTINCT ligand_id) FROM scores) - ids AS missing_ids, label_differs, (SELECT crossing FROM lk) AS crossing_groups, round(auc, 5) AS second_auc, round(ap, 5) AS second_precision,
  abs(auc - sf.roc_auc) < 1E-6 AND abs(ap - sf.average_precision) < 1E-6 AS metrics_agree FROM ax JOIN au USING (family) JOIN pr USING (family) JOIN ld USING (family) JOIN sf USING (family)""")
def q_cv_gate_audit(v: Views) -> DataFrame:
    """The held-out scores of the nested families as stored in files: ids, labels, groups that cross folds, and metrics by a second formulation."""
    n = Nested(v)
    folder = resume.scratch(v.spark, "oof")
    n.held_out().select("family", "ligand_id", "label", F.col("score").cast("double").alias("score"), "part").write.parquet(folder)
    stored = v.spark.read.parquet(folder)
    reported = n.pooled().select("family", "roc_auc", "average_precision")
    want = v.ligands.select("ligand_id", F.col("label").alias("__label"), "group_id")
    known = stored.join(want, "ligand_id", "left")
    every = v.scores.agg(F.count_distinct("ligand_id").alias("all"))
    counts = known.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ligand_id").alias("ids"), F.count_if(~F.col("label").eqNullSafe(F.col("__label"))).alias("label_differs"))
    one_family = known.filter("family = 'single_best'").select("group_id", "part")  # folds are the same for all
    crossing = audit.crossing_groups(one_family, "group_id", "part").agg(F.count(F.lit(1)).alias("crossing_groups"))
    out = counts.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(crossing)).join(second_metrics(stored, ["family"]), "family").join(reported, "family")  # one row each
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 1e-6
    return out.select(
        "family",
        (F.col("rows") - F.col("ids")).alias("repeated_ids"),
        (F.col("all") - F.col("ids")).alias("missing_ids"),
        "label_differs",
        "crossing_groups",
        F.round("second_auc", 5).alias("second_auc"),
        F.round("second_precision", 5).alias("second_precision"),
        (near("second_auc", "roc_auc") & near("second_precision", "average_precision")).alias("metrics_agree"),
    )


ALPHA, FRACTIONS = 80.5, (0.02, 0.15, 0.3)
_OTHER = METRICS.format(keys="receptor_id", rows="scores").replace("-20.0E0", f"-{ALPHA}E0").replace("0.01E0", "0.02E0").replace("0.05E0", "0.15E0").replace("0.1E0", "0.3E0")


@query(f"WITH {_OTHER} SELECT receptor_id, roc_auc, average_precision, bedroc AS bedroc_80_5, ef1 AS ef2, ef5 AS ef15, ef10 AS ef30, round(ef1 / ef10, 6) AS early_ratio FROM mx")
def q_scalar_bundle(v: Views) -> DataFrame:
    """Rank metrics with a steeper early recognition and other fractions, and how much of the enrichment comes early."""
    out = rounded(ranking.metrics(v.scores, ["receptor_id"], alpha=ALPHA, fractions=FRACTIONS, top=0), "roc_auc", "average_precision", "bedroc", "ef2", "ef15", "ef30")
    return out.select("receptor_id", "roc_auc", "average_precision", F.col("bedroc").alias("bedroc_80_5"), "ef2", "ef15", "ef30", F.round(F.col("ef2") / F.col("ef30"), 6).alias("early_ratio"))


STEPS, REPORT, CHECKPOINT, FEMTOSECONDS = 70, 5, 10, 2.5


@query(f"""WITH d AS (SELECT run_id, max(frame) AS done FROM frames GROUP BY run_id)
SELECT run_id, done, CASE WHEN done > {STEPS} THEN 'beyond_schedule' WHEN done = {STEPS} THEN 'complete' WHEN done < {CHECKPOINT} THEN 'restart' ELSE 'resume' END AS state,
  CASE WHEN done > {STEPS} THEN NULL ELSE CAST(done // {CHECKPOINT} * {CHECKPOINT} AS INT) END AS resume_at, CASE WHEN done > {STEPS} THEN NULL ELSE CAST({STEPS} - done // {CHECKPOINT} * {CHECKPOINT} AS INT) END AS steps_left,
  CASE WHEN done > {STEPS} THEN NULL ELSE CAST(done // {REPORT} AS INT) END AS reports, round(done * {FEMTOSECONDS}E0 / 1000, 9) AS done_ps FROM d""")
def q_step_resume(v: Views) -> DataFrame:
    """Runs by how far they have come in a schedule of steps: where each goes on, from its last checkpoint, or why it cannot."""
    done = v.frames.groupBy("run_id").agg(F.max("frame").alias("done"))
    schedule = resume.Schedule(STEPS, REPORT, CHECKPOINT)
    out = resume.resume_points(done, "done", schedule)
    return out.withColumn("done_ps", F.round(units.femtoseconds_to_picoseconds(F.col("done") * FEMTOSECONDS), 9)).select("run_id", "done", "state", "resume_at", "steps_left", "reports", "done_ps")


@query("""SELECT source, count(*) AS records, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank_texts, count(*) - count(lang) AS without_language,
  count(*) - count(DISTINCT doc_id) AS repeated_ids, count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS wrong_length, min(n_chars) AS shortest, max(n_chars) AS longest,
  count(text) - count(DISTINCT text) AS repeated_texts FROM documents GROUP BY source""")
def q_intake_audit(v: Views) -> DataFrame:
    """Counts over incoming records by source: blanks, repeats, and lengths that are not what the record says."""
    d = v.table("documents", "doc_id", "text", "lang", "source", "n_chars")
    digest = d.withColumn("t", F.sha2("text", 256))  # texts may be long; their repeats are told by digest
    return digest.groupBy("source").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("blank_texts"),
        F.count_if(F.col("lang").isNull()).alias("without_language"),
        (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("repeated_ids"),
        F.count_if(~F.col("n_chars").eqNullSafe(F.length("text"))).alias("wrong_length"),
        F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"),
        (F.count("t") - F.count_distinct("t")).alias("repeated_texts"),
    )


_PERIOD = "CAST(floor(epoch(ts) / 86400) AS BIGINT)"


@query(f"""WITH e AS (SELECT user_id, {_PERIOD} AS day, value FROM events) SELECT user_id, CAST(count(DISTINCT day) AS BIGINT) AS active_days, max(day) - min(day) + 1 AS span_days, round(sum(value) / 1000, 6) AS kilo,
  (max(day) - min(day) + 1) % 7 = 0 AS whole_weeks FROM e GROUP BY user_id""")
def q_period_units(v: Views) -> DataFrame:
    """Days and spans of each run, sums in larger units, and whether the span is a whole number of weeks."""
    seconds = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts"))
    e = v.table("events", "user_id", "ts", "value").withColumn("day", F.floor(seconds / 86400).cast("long"))
    span = F.max("day") - F.min("day") + 1
    out = e.groupBy("user_id").agg(F.count_distinct("day").alias("active_days"), span.alias("span_days"), F.round(units.scaled(F.sum("value"), 1000), 6).alias("kilo"))
    return out.withColumn("whole_weeks", units.is_multiple(F.col("span_days"), 7))

"""Queries: the frozen choice of one scorer on development rows, its evaluation on locked rows, and the audit before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import objective as obj
from orrery.operators import ranking
from orrery.plans.q_core import DOUBLES, METRICS, rounded
from orrery.plans.q_delta_gate import GATE_SQL, replicate_matrices
from orrery.plans.registry import query
from orrery.plans.views import RECEPTORS, Views
from orrery.sources import release

LOCKED = "test"
_MATRICES = GATE_SQL[: GATE_SQL.index(",\nfd AS")]
_RANKED = f"""{_MATRICES}, ms AS (SELECT rm.*, l.split FROM rm JOIN ligands l USING (ligand_id) WHERE mid IN ('primary', 'sensitivity')),
dv AS (SELECT * FROM ms WHERE split <> '{LOCKED}'), dm AS (SELECT * FROM (WITH {METRICS.format(keys="mid, receptor_id", rows="dv")} SELECT * FROM mx)),
rr AS (SELECT p.receptor_id, CAST(row_number() OVER (ORDER BY p.bedroc DESC NULLS LAST, p.average_precision DESC NULLS LAST, p.roc_auc DESC NULLS LAST, p.receptor_id) AS INT) AS place, p.roc_auc, p.average_precision, p.bedroc, s.bedroc AS sensitivity_bedroc
  FROM dm p JOIN dm s ON s.receptor_id = p.receptor_id WHERE p.mid = 'primary' AND s.mid = 'sensitivity')"""


def _matrices(v: Views) -> DataFrame:
    rows = replicate_matrices(v).filter(F.col("matrix_id").isin("primary", "sensitivity"))
    return rows.join(v.ligands.select("ligand_id", "split"), "ligand_id")


def _ranking(v: Views) -> DataFrame:
    found = rounded(ranking.metrics(_matrices(v).filter(F.col("split") != LOCKED), ["matrix_id", "receptor_id"], top=0), *DOUBLES)
    other = found.filter("matrix_id = 'sensitivity'").select("receptor_id", F.col("bedroc").alias("sensitivity_bedroc"))
    out = found.filter("matrix_id = 'primary'").join(other, "receptor_id")
    place = F.row_number().over(obj.Window.partitionBy(F.lit(0)).orderBy(F.desc("bedroc"), F.desc("average_precision"), F.desc("roc_auc"), "receptor_id"))  # a row per receptor
    return out.select("receptor_id", place.alias("place"), "roc_auc", "average_precision", "bedroc", "sensitivity_bedroc")


@query(f"WITH {_RANKED} SELECT *, place = 1 AS selected FROM rr")
def q_frozen_ranking(v: Views) -> DataFrame:
    """Receptors by their metrics on the development rows alone; the first is what a freeze fixes."""
    return _ranking(v).withColumn("selected", F.col("place") == 1)


@query(f"""WITH {_RANKED}, lk AS (SELECT ms.* FROM ms JOIN rr USING (receptor_id) WHERE split = '{LOCKED}' AND place = 1), lm AS (SELECT * FROM (WITH {METRICS.format(keys="mid, receptor_id", rows="lk")} SELECT * FROM mx))
SELECT mid AS matrix_id, receptor_id, ligand_count, active_count, roc_auc, average_precision, bedroc, ef1, ef5, ef10 FROM lm""")
def q_locked_evaluation(v: Views) -> DataFrame:
    """The frozen receptor on the locked rows, by the median and by the minimum of its replicates."""
    chosen = _ranking(v).filter("place = 1").select("receptor_id")
    rows = _matrices(v).filter(F.col("split") == LOCKED).join(F.broadcast(chosen), "receptor_id")  # one row
    out = rounded(ranking.metrics(rows, ["matrix_id", "receptor_id"], top=0), *DOUBLES)
    return out.select("matrix_id", "receptor_id", "ligand_count", "active_count", *DOUBLES)


@query(f"""WITH m AS (SELECT q.receptor_id, q.ligand_id, count(*) AS n, max(CASE WHEN l.heavy_atoms <= 12 THEN 'active' ELSE 'decoy' END) AS had FROM seed_scores q JOIN ligands l ON l.ligand_id = q.ligand_id GROUP BY q.receptor_id, q.ligand_id),
k AS (SELECT r_regionkey AS receptor_id, ligand_id, label, split FROM ligands, region WHERE split <> 'validation'),
b AS (SELECT coalesce(m.receptor_id, k.receptor_id) AS receptor_id, m.n, m.had, k.label, k.split, m.ligand_id AS seen, k.ligand_id AS known FROM m FULL JOIN k ON m.receptor_id = k.receptor_id AND m.ligand_id = k.ligand_id)
SELECT receptor_id, count(*) FILTER (n > 1) AS repeated_id, count(*) FILTER (known IS NULL) AS unknown_id, count(*) FILTER (seen IS NULL) AS missing_id,
  count(*) FILTER (had <> label) AS label_differs, count(*) FILTER (seen IS NULL AND split = '{LOCKED}') AS locked_missing FROM b GROUP BY receptor_id""")
def q_locked_audit(v: Views) -> DataFrame:
    """What is wrong, by receptor, with a matrix of single replicates under an older label rule against a manifest without the validation rows; a release of it would be refused."""
    manifest = v.ligands.select("ligand_id", "label", "split").filter("split <> 'validation'")
    older = v.ligands.select("ligand_id", F.when(F.col("heavy_atoms") <= 12, "active").otherwise("decoy").alias("label"))
    out = None
    for r in RECEPTORS:
        column = v.seed_scores.filter(F.col("receptor_id") == r).select("ligand_id", "score").join(older, "ligand_id")
        one = release.locked_audit(column, manifest, "ligand_id", "label", "score", "split", LOCKED).withColumn("receptor_id", F.lit(r))
        out = one if out is None else out.unionByName(one)
    names = ["repeated_id", "unknown_id", "missing_id", "label_differs", "locked_missing"]
    return out.groupBy("receptor_id").agg(*[F.max(F.when(F.col("violation") == n, F.col("n"))).alias(n) for n in names])

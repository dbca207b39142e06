"""Queries: objectives tuned on validation rows, and families of objectives inside nested folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import folds, ranking
from orrery.operators import objective as obj
from orrery.operators import subsets as sub
from orrery.operators.ranksums import billionths, subset_metrics
from orrery.plans.q_core import DOUBLES, METRICS, rounded
from orrery.plans.q_select import NAME
from orrery.plans.registry import query
from orrery.plans.views import RECEPTORS, Views

HOWS = "min", "mean"
CHOICE = "roc_auc", "average_precision", "bedroc", "ef1", "ef5"


def of_k(keys: str, alias: str) -> str:
    return ", ".join(f"{alias}.{k.strip()}" for k in keys.split(","))


def ensembles_sql(keys: str, rows: str, sizes: str) -> str:
    """``ee``: scores of subsets by ``keys``, ``em``: their metrics."""
    return f"""es AS (SELECT {keys}, mask, ligand_id, label, min(score) AS low, round(avg(score), 9) AS middle FROM {rows} JOIN range(1, 32) t(mask) ON (mask >> receptor_id) & 1 = 1 AND bit_count(mask) IN ({sizes}) GROUP BY ALL),
ee AS (SELECT {keys}, 'min' AS how, mask, ligand_id, label, low AS score FROM es UNION ALL SELECT {keys}, 'mean', mask, ligand_id, label, middle FROM es WHERE bit_count(mask) > 1),
em AS (SELECT * FROM (WITH {METRICS.format(keys=f"{keys}, how, mask", rows="ee")} SELECT * FROM mx))"""


def terms_sql(keys: str, train: str, measured: str) -> str:
    """``u1``: terms of single receptors, ``b1``: of pairs, by ``keys`` and unscaled."""
    return f"""r1 AS (SELECT *, row_number() OVER (PARTITION BY {keys}, receptor_id ORDER BY score, ligand_id) AS r, count(*) OVER (PARTITION BY {keys}, receptor_id) AS n,
  rank() OVER (PARTITION BY {keys}, receptor_id ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, receptor_id, score) - 1) / 2.0E0 AS ar FROM {train}),
t1 AS (SELECT {keys}, receptor_id, ligand_id, label FROM r1 WHERE r <= greatest(1, ceil(n * 0.1E0))),
h1 AS (SELECT {keys}, receptor_id AS member, count(*) FILTER (label = 'active') AS hits, count(*) FILTER (label <> 'active') AS misses FROM t1 GROUP BY ALL),
s1 AS (SELECT {keys}, CAST(log2(mask) AS INT) AS member, roc_auc AS utility, bedroc, active_count, ligand_count FROM {measured} WHERE bit_count(mask) = 1),
u1 AS (SELECT {keys}, member, utility, round(hits * 1.0E0 / active_count, 6) AS coverage, round(misses * 1.0E0 / (ligand_count - active_count), 6) AS exposure FROM s1 JOIN h1 USING ({keys}, member)),
c1 AS (SELECT {of_k(keys, "s")}, s.receptor_id AS x, t.receptor_id AS y, count(*) AS shared FROM t1 s JOIN t1 t USING ({keys}, ligand_id) WHERE s.receptor_id < t.receptor_id AND s.label = 'active' GROUP BY ALL),
q1 AS (SELECT {of_k(keys, "s")}, s.receptor_id AS x, t.receptor_id AS y, (1 << s.receptor_id) + (1 << t.receptor_id) AS mask, greatest(0, round(corr(s.ar, t.ar), 6)) AS redundancy FROM r1 s JOIN r1 t USING ({keys}, ligand_id) WHERE s.receptor_id < t.receptor_id GROUP BY ALL),
p1 AS (SELECT {keys}, mask, max(bedroc) FILTER (how = 'min') AS pair_utility_min, max(bedroc) FILTER (how = 'mean') AS pair_utility_mean, max(active_count) AS actives FROM {measured} WHERE bit_count(mask) = 2 GROUP BY {keys}, mask),
b1 AS (SELECT {of_k(keys, "q1")}, q1.x, q1.y, redundancy, round(coalesce(shared, 0) * 1.0E0 / actives, 6) AS overlap, pair_utility_min, pair_utility_mean,
  round(pair_utility_min - greatest(i.bedroc, j.bedroc), 6) AS pair_synergy_min, round(pair_utility_mean - greatest(i.bedroc, j.bedroc), 6) AS pair_synergy_mean
  FROM q1 JOIN p1 USING ({keys}, mask) JOIN (SELECT {keys}, member AS x, bedroc FROM s1) i USING ({keys}, x) JOIN (SELECT {keys}, member AS y, bedroc FROM s1) j USING ({keys}, y) LEFT JOIN c1 USING ({keys}, x, y))"""


def scaled_sql(keys: str, names: Sequence[str], signed: Sequence[str] = (), constant: str = "0") -> str:
    over = f"OVER (PARTITION BY {keys})"
    out = [f"CASE WHEN max({c}) {over} = min({c}) {over} THEN {constant} ELSE ({c} - min({c}) {over}) / (max({c}) {over} - min({c}) {over}) END AS {c}" for c in names]
    return ", ".join([*out, *[f"CASE WHEN max(abs({c})) {over} = 0 THEN 0 ELSE {c} / max(abs({c})) {over} END AS {c}" for c in signed]])


PAIR_TERMS = ["redundancy", "overlap", "pair_utility_min", "pair_utility_mean"]
SIGNED_TERMS = ["pair_synergy_min", "pair_synergy_mean"]
UNARY_TERMS = ["utility", "coverage", "exposure", "stability"]


def sums_sql(keys: str, unary: str, pairs: str) -> str:
    """``su``: sums of the terms by ``keys`` and subset."""
    two = [*PAIR_TERMS, *SIGNED_TERMS]
    return f"""su AS (SELECT * FROM (SELECT {keys}, mask, CAST(bit_count(mask) AS INT) AS size, {", ".join(f"sum({c}) AS {c}" for c in UNARY_TERMS)} FROM {unary} JOIN range(1, 32) t(mask) ON (mask >> member) & 1 = 1 GROUP BY ALL)
  LEFT JOIN (SELECT {keys}, mask, {", ".join(f"sum({c}) AS {c}" for c in two)} FROM {pairs} JOIN range(1, 32) t(mask) ON (mask >> x) & 1 = 1 AND (mask >> y) & 1 = 1 GROUP BY ALL) USING ({keys}, mask))"""


def energy_sql(penalty: float) -> str:
    out = f"-utility + {penalty}E0 * (size - target) * (size - target)"
    for w, (sign, term) in {**obj.UNARY, **obj.PAIR}.items():
        out += f" + {sign} * {w} * coalesce({term}, 0)"
    for w, (sign, term) in obj.BY_HOW.items():
        out += f" + {sign} * {w} * coalesce(CASE WHEN how = 'min' THEN {term}_min ELSE {term}_mean END, 0)"
    return f"round({out}, 9)"


def candidates_sql(rows: Sequence[tuple]) -> str:
    values = ", ".join(f"({i}, '{f}', {t}, '{h}', {', '.join(f'{w}E0' for w in ws)})" for i, (f, t, h, *ws) in enumerate(rows))
    return f"cf AS (SELECT * FROM (VALUES {values}) t(cid, family, target, how, {', '.join(obj.WEIGHTS)}))"


# --- weights tuned on the validation rows --------------------------------------------------

TUNED = [c for size in (2, 3) for c in obj.candidate_grid("tuned", (size,), ("min",), w_coverage=(0, 0.5, 1), w_overlap=(0, 0.5, 1), w_redundancy=(0, 0.25, 0.5))]
TUNED_PENALTY = 1.0
TUNED_SQL = f"""{ensembles_sql("split", "scores", "1, 2, 3, 5")},
tr AS (SELECT * FROM scores WHERE split = 'train'), mt AS (SELECT * FROM em WHERE split = 'train'), {terms_sql("split", "tr", "mt")},
u2 AS (SELECT split, member, coverage, exposure, 0 AS stability, {scaled_sql("split", ["utility"], constant="0.5")} FROM u1),
{sums_sql("split", "u2", "b1")}, {candidates_sql(TUNED)},
en AS (SELECT cf.*, mask, {energy_sql(TUNED_PENALTY)} AS energy FROM su JOIN cf ON size = target),
so AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY energy, {NAME}) AS nth FROM en) WHERE nth = 1),
tq AS (SELECT so.*, em.roc_auc, em.bedroc, row_number() OVER (PARTITION BY target ORDER BY em.roc_auc DESC NULLS LAST, em.bedroc DESC NULLS LAST, {NAME.replace("mask", "so.mask")} DESC, cid) = 1 AS chosen
  FROM so JOIN em ON em.mask = so.mask AND em.how = so.how AND em.split = 'validation')"""


def split_ensembles(v: Views) -> tuple[DataFrame, DataFrame]:
    """Scores, once, and the metrics of all subsets of one, two, three and all receptors by split."""
    scores = folds.checkpointed(v.scores)
    rows = scores.withColumn("score", billionths("score"))
    found = subset_metrics(rows, sub.k_subsets(v.spark, RECEPTORS, (1, 2, 3, 5)), RECEPTORS, ["split"], whole=True)
    return scores, folds.checkpointed(rounded(found, *DOUBLES))


def tuned_trials(v: Views, scores: DataFrame, found: DataFrame) -> DataFrame:
    """The train-only subset of every grid point with its validation metrics; the best per size is ``chosen``."""
    unary, pairs = obj.raw_terms(scores.filter("split = 'train'"), found.filter("split = 'train'"), ["split"], "roc_auc")
    low, high = F.min("utility").over(obj.Window.partitionBy("split")), F.max("utility").over(obj.Window.partitionBy("split"))
    scaled = F.when(low == high, 0.5).otherwise((F.col("utility") - low) / (high - low))
    unary = unary.withColumns({"utility": scaled, "stability": F.lit(0.0)})
    sums = obj.term_sums(unary, pairs, sub.k_subsets(v.spark, RECEPTORS), ["split"]).withColumn("required", F.lit(0).cast("long"))
    trials = obj.solved(sums, obj.candidate_table(v.spark, TUNED), ["split"], TUNED_PENALTY)
    seen = found.filter("split = 'validation'").select("how", "mask", "roc_auc", "bedroc")
    trials = trials.drop("split").join(seen, ["how", "mask"])
    order = obj.Window.partitionBy("target").orderBy(F.desc("roc_auc"), F.desc("bedroc"), F.desc(obj.in_order("mask")), "cid")
    return trials.withColumn("chosen", F.row_number().over(order) == 1)


def named(mask: str = "mask"):
    return F.array_join(F.transform(obj.in_order(mask), lambda r: r.cast("string")), "+")


@query(f"WITH {TUNED_SQL} SELECT target, w_coverage, w_overlap, w_redundancy, {NAME} AS subset, round(energy, 8) AS objective, roc_auc, bedroc, chosen FROM tq")
def q_qubo_grid(v: Views) -> DataFrame:
    """Every point of the weight grid: the subset that its train-only terms choose, judged on the validation rows."""
    t = tuned_trials(v, *split_ensembles(v))
    return t.select("target", "w_coverage", "w_overlap", "w_redundancy", named().alias("subset"), F.round("energy", 8).alias("objective"), "roc_auc", "bedroc", "chosen")


@query(f"""WITH {TUNED_SQL}, bt AS (SELECT how, bit_count(mask) AS size, mask, row_number() OVER (PARTITION BY how, bit_count(mask) ORDER BY roc_auc DESC NULLS LAST, {NAME} DESC) AS nth FROM em WHERE split = 'train'),
me2 AS (SELECT 'single_best' AS method, how, mask FROM bt WHERE nth = 1 AND size = 1 UNION ALL SELECT 'train_best', how, mask FROM bt WHERE nth = 1 AND size = 2
  UNION ALL SELECT 'tuned', how, mask FROM tq WHERE chosen AND target = 2 UNION ALL SELECT 'all', how, mask FROM bt WHERE size = 5)
SELECT split, method, how, {NAME} AS subset, {", ".join(CHOICE)} FROM me2 JOIN em USING (how, mask)""")
def q_ensemble_methods(v: Views) -> DataFrame:
    """The tuned pair beside what the train rows choose and all receptors, on every split."""
    scores, found = split_ensembles(v)
    size = F.bit_count("mask")
    best = obj.pick(found.filter("split = 'train'").withColumn("size", size), ["how", "size"], F.desc("roc_auc"), F.desc(obj.in_order("mask")))
    method = F.when(F.col("size") == 1, "single_best").when(F.col("size") == 2, "train_best").when(F.col("size") == 5, "all")
    methods = best.select(method.alias("method"), "how", "mask").filter("method is not null")
    tuned = tuned_trials(v, scores, found).filter("chosen and target = 2").select(F.lit("tuned").alias("method"), "how", "mask")
    out = found.join(F.broadcast(methods.unionByName(tuned)), ["how", "mask"])  # a row per method
    return out.select("split", "method", "how", named().alias("subset"), *CHOICE)


# --- families inside nested folds --------------------------------------------------------------

K, SIZES, PENALTY, FREQUENCY = 4, (2, 3), 4.0, 0.75
_BASE = {"w_coverage": (0.5, 1.0), "w_overlap": (0.5,), "w_redundancy": (0.25, 1.0)}
FREE = [
    *obj.candidate_grid("coverage", SIZES, HOWS, **_BASE),
    *obj.candidate_grid("discriminative", SIZES, HOWS, **{**_BASE, "w_redundancy": (0.25,), "w_exposure": (0.5, 1.0)}),
    *obj.candidate_grid("pair_utility", SIZES, HOWS, w_coverage=(0.5,), w_overlap=(0.5,), w_redundancy=(0.25,), w_utility=(0.5, 1.0)),
    *obj.candidate_grid("pair_synergy", SIZES, HOWS, w_coverage=(0.5,), w_redundancy=(0.25,), w_synergy=(0.5, 1.0)),
    *obj.candidate_grid("stability", SIZES, HOWS, w_coverage=(0.5, 1.0), w_overlap=(0.5,), w_redundancy=(0.25,), w_stability=(0.5,)),
]
BOUND = [
    *obj.candidate_grid("consensus", (3,), HOWS, **_BASE),
    *obj.candidate_grid("core_plus_one", (2,), HOWS, **_BASE),
    *obj.candidate_grid("core_plus_two", (3,), HOWS, **_BASE),
]
CLASSICAL = [
    *obj.candidate_grid("single_best", (1,), ("min",)),
    *obj.candidate_grid("exhaustive", SIZES, HOWS),
    *obj.candidate_grid("greedy", SIZES, HOWS),
    *obj.candidate_grid("all_receptors", (5,), HOWS),
]
FAMILIES = [*CLASSICAL, *FREE, *BOUND]
OBJECTIVES = ["coverage", "discriminative", "pair_utility", "pair_synergy", "stability", "consensus", "core_plus_one", "core_plus_two"]
#: Outer fold (-1: none), inner fold (the same: the outer fit) and the context that is fitted there.
ROLES = [(o, i, min(x, y), max(x, y)) for o in (-1, *range(K)) for i in ((-1, *range(K)) if o < 0 else range(K)) for x, y in [(i, i) if o < 0 else (o, i)]]

_FREE_IDS = ", ".join(str(i) for i, c in enumerate(FAMILIES) if c in FREE)
_CHOOSE = "row_number() OVER (PARTITION BY o, family ORDER BY inner_bedroc DESC NULLS LAST, inner_precision DESC NULLS LAST, inner_auc DESC NULLS LAST, inner_spread NULLS LAST, target, weight, cid)"
_TRIAL = f"""SELECT o, cid, any_value(cf.family) AS family, any_value(cf.target) AS target, any_value(cf.how) AS how, any_value({" + ".join(obj.WEIGHTS)}) AS weight, round(avg(em.bedroc), 8) AS inner_bedroc,
  round(avg(em.average_precision), 8) AS inner_precision, round(avg(em.roc_auc), 8) AS inner_auc, round(stddev_pop(em.bedroc), 6) AS inner_spread
  FROM {{fits}} f JOIN cf USING (cid) JOIN em ON em.xa = f.xa AND em.xb = f.xb AND em.part = f.i AND em.how = cf.how AND em.mask = f.mask WHERE f.i <> f.o GROUP BY o, cid"""
FAMILY_SQL = f"""fo AS (SELECT *, CAST((row_number() OVER (PARTITION BY receptor_id, label ORDER BY sha256('3|' || ligand_id), ligand_id) - 1) % {K} AS INT) AS fold FROM scores),
cx AS (SELECT * FROM (VALUES {", ".join(map(str, obj.contexts(K)))}) t(xa, xb)), ro AS (SELECT * FROM (VALUES {", ".join(map(str, ROLES))}) t(o, i, xa, xb)),
cb AS (SELECT xa, xb, receptor_id, min(score) AS lo, max(score) AS hi FROM fo, cx WHERE fold <> xa AND fold <> xb GROUP BY ALL),
cr AS (SELECT xa, xb, CASE WHEN fold = xa OR fold = xb THEN fold ELSE -1 END AS part, fo.receptor_id, ligand_id, label, CASE WHEN hi = lo THEN 0 ELSE CAST(round((score - lo) / (hi - lo) * 1E9) AS BIGINT) END AS score FROM fo JOIN cb ON cb.receptor_id = fo.receptor_id),
{ensembles_sql("xa, xb, part", "cr", "1, 2, 3, 5")}, tr AS (SELECT * FROM cr WHERE part = -1), mt AS (SELECT * FROM em WHERE part = -1), {terms_sql("xa, xb", "tr", "mt")},
u2 AS (SELECT xa, xb, member, {scaled_sql("xa, xb", ["utility", "coverage", "exposure"])} FROM u1), b2 AS (SELECT xa, xb, x, y, {scaled_sql("xa, xb", PAIR_TERMS, SIGNED_TERMS)} FROM b1),
st AS (SELECT o, member, round(avg(utility) - stddev_pop(utility), 9) AS stability FROM ro JOIN u2 USING (xa, xb) WHERE i <> o GROUP BY o, member), s2 AS (SELECT o, member, {scaled_sql("o", ["stability"])} FROM st),
u3 AS (SELECT o, i, u2.* EXCLUDE (xa, xb), CASE WHEN o = i THEN s2.stability ELSE 0 END AS stability FROM ro JOIN u2 USING (xa, xb) JOIN s2 USING (o, member)), b3 AS (SELECT o, i, b2.* EXCLUDE (xa, xb) FROM ro JOIN b2 USING (xa, xb)),
{sums_sql("o, i", "u3", "b3")}, {candidates_sql(FAMILIES)},
ff AS (SELECT o, i, cid, mask FROM (SELECT o, i, cid, mask, row_number() OVER (PARTITION BY o, i, cid ORDER BY {energy_sql(PENALTY)}, {NAME}) AS nth FROM su, cf WHERE cid IN ({_FREE_IDS})) WHERE nth = 1),
ex AS (SELECT xa, xb, how, CAST(bit_count(mask) AS INT) AS target, mask, row_number() OVER (PARTITION BY xa, xb, how, bit_count(mask) ORDER BY bedroc DESC NULLS LAST, {NAME}) AS nth, bedroc FROM mt),
g1 AS (SELECT xa, xb, mask FROM ex WHERE target = 1 AND nth = 1),
g2 AS (SELECT * FROM (SELECT ex.xa, ex.xb, how, ex.mask, row_number() OVER (PARTITION BY ex.xa, ex.xb, how ORDER BY bedroc DESC NULLS LAST, {NAME.replace("mask", "ex.mask")}) AS k FROM ex JOIN g1 ON ex.xa = g1.xa AND ex.xb = g1.xb AND target = 2 AND ex.mask & g1.mask = g1.mask) WHERE k = 1),
g3 AS (SELECT * FROM (SELECT ex.xa, ex.xb, ex.how, ex.mask, row_number() OVER (PARTITION BY ex.xa, ex.xb, ex.how ORDER BY bedroc DESC NULLS LAST, {NAME.replace("mask", "ex.mask")}) AS k FROM ex JOIN g2 ON ex.xa = g2.xa AND ex.xb = g2.xb AND ex.how = g2.how AND target = 3 AND ex.mask & g2.mask = g2.mask) WHERE k = 1),
cl AS (SELECT xa, xb, cid, mask FROM ex JOIN cf USING (how, target) WHERE nth = 1 AND family IN ('single_best', 'exhaustive', 'all_receptors')
  UNION ALL SELECT xa, xb, cid, mask FROM g2 JOIN cf USING (how) WHERE family = 'greedy' AND target = 2 UNION ALL SELECT xa, xb, cid, mask FROM g3 JOIN cf USING (how) WHERE family = 'greedy' AND target = 3),
f1 AS (SELECT o, i, xa, xb, cid, mask FROM ro JOIN ff USING (o, i) UNION ALL SELECT o, i, xa, xb, cid, mask FROM ro JOIN cl USING (xa, xb)),
v1 AS ({_TRIAL.format(fits="f1")}), w1 AS (SELECT * FROM (SELECT *, {_CHOOSE} AS nth FROM v1) WHERE nth = 1),
me3 AS (SELECT o, r AS member, count(*) AS times FROM f1 JOIN w1 USING (o, cid), range(0, 5) t(r) WHERE w1.family = 'coverage' AND i <> o AND (mask >> r) & 1 = 1 GROUP BY o, r),
nc AS (SELECT o, count(*) FILTER (i <> o) AS inner_folds FROM ro GROUP BY o),
sb AS (SELECT o, member, row_number() OVER (PARTITION BY o ORDER BY times DESC, member) AS k FROM me3 JOIN nc USING (o) WHERE times * 1.0E0 / inner_folds >= {FREQUENCY} - 1E-12),
rq AS (SELECT nc.o, 'consensus' AS family, CAST(coalesce(sum(1 << member), 0) AS BIGINT) AS required FROM nc LEFT JOIN sb ON sb.o = nc.o GROUP BY nc.o
  UNION ALL SELECT o, f, 1 << member FROM sb, (VALUES ('core_plus_one'), ('core_plus_two')) t(f) WHERE k = 1),
fb AS (SELECT o, i, cid, mask FROM (SELECT o, i, cid, mask, row_number() OVER (PARTITION BY o, i, cid ORDER BY {energy_sql(PENALTY)}, {NAME}) AS nth FROM su JOIN rq USING (o) JOIN cf USING (family) WHERE mask & required = required AND size = target) WHERE nth = 1),
f2 AS (SELECT * FROM f1 UNION ALL SELECT o, i, xa, xb, cid, mask FROM ro JOIN fb USING (o, i)),
v2 AS ({_TRIAL.format(fits="f2")}), w2 AS (SELECT w.*, f2.mask, f2.xa, f2.xb FROM (SELECT * FROM (SELECT *, {_CHOOSE} AS nth FROM v2) WHERE nth = 1) w JOIN f2 ON f2.o = w.o AND f2.cid = w.cid AND f2.i = w.o),
oo AS (SELECT w2.family, ee.ligand_id, ee.label, ee.score FROM w2 JOIN ee ON ee.xa = w2.o AND ee.xb = w2.o AND ee.part = w2.o AND ee.how = w2.how AND ee.mask = w2.mask WHERE w2.o >= 0),
om AS (SELECT * FROM (WITH {METRICS.format(keys="family", rows="oo")} SELECT * FROM mx)),
od AS (SELECT * FROM (VALUES {", ".join(f"('{f}', {i})" for i, f in enumerate(OBJECTIVES))}) t(family, place)),
sf AS (SELECT om.*, CASE WHEN place IS NOT NULL THEN row_number() OVER (PARTITION BY place IS NULL ORDER BY bedroc DESC NULLS LAST, average_precision DESC NULLS LAST, roc_auc DESC NULLS LAST, place) = 1 ELSE false END AS selected FROM om LEFT JOIN od USING (family))"""


class Nested:
    """The steps of the nested selection; what several steps use is written once."""

    def __init__(self, v: Views):
        self.v = v
        ligands = folds.label_folds(v.scores.select("ligand_id", "label").distinct(), "ligand_id", "label", K, 3)
        rows = folds.checkpointed(obj.context_rows(v.scores.join(ligands.select("ligand_id", "fold"), "ligand_id"), K))
        self.rows, self.subsets = rows, sub.k_subsets(v.spark, RECEPTORS, (1, 2, 3, 5))
        self.found = folds.checkpointed(rounded(subset_metrics(rows, self.subsets, RECEPTORS, [*obj.CONTEXT, "part"]), *DOUBLES))
        self.roles = F.broadcast(v.spark.createDataFrame(ROLES, "o int, i int, a int, b int"))
        self.table = obj.candidate_table(v.spark, FAMILIES)
        measured = self.found.filter(F.col("part") == obj.FULL)
        unary, pairs = obj.raw_terms(rows.filter(F.col("part") == obj.FULL), measured, obj.CONTEXT, "roc_auc")
        self.sums = folds.checkpointed(self._sums(unary, pairs))
        self.fits = folds.checkpointed(self._free().unionByName(self._classical(measured)))
        required = folds.checkpointed(self._required(self._first(self._trials(self.fits))))
        bound = obj.solved(self.sums.join(required, "o"), self._of(BOUND).withColumnRenamed("family", "f"), ["o", "i", "family"], PENALTY)
        bound = bound.filter("family = f").join(self.roles, ["o", "i"]).select(self.fits.columns)
        self.required = required
        self.fits = folds.checkpointed(self.fits.unionByName(bound))

    def _of(self, rows: Sequence[tuple]) -> DataFrame:
        return self.table.filter(F.col("family").isin(sorted({r[0] for r in rows})))

    def _sums(self, unary: DataFrame, pairs: DataFrame) -> DataFrame:
        unary = obj.scaled_by(unary, obj.CONTEXT, ["utility", "coverage", "exposure"])
        pairs = obj.scaled_by(pairs, obj.CONTEXT, PAIR_TERMS, SIGNED_TERMS)
        placed = unary.join(self.roles, obj.CONTEXT)
        steady = placed.filter("i <> o").groupBy("o", "member").agg(F.round(F.avg("utility") - F.stddev_pop("utility"), 9).alias("stability"))
        placed = placed.join(obj.scaled_by(steady, ["o"], ["stability"]), ["o", "member"])
        placed = placed.withColumn("stability", F.when(F.col("o") == F.col("i"), F.col("stability")).otherwise(0.0)).drop(*obj.CONTEXT)
        return obj.term_sums(placed, pairs.join(self.roles, obj.CONTEXT).drop(*obj.CONTEXT), sub.k_subsets(self.v.spark, RECEPTORS), ["o", "i"])

    def _free(self) -> DataFrame:
        fits = obj.solved(self.sums, self._of(FREE), ["o", "i"], PENALTY)
        return fits.join(self.roles, ["o", "i"]).select("o", "i", "a", "b", "cid", "mask")

    def _classical(self, measured: DataFrame) -> DataFrame:
        measured = measured.select("a", "b", "how", "mask", "bedroc", F.bit_count("mask").alias("target"))
        order = [F.desc("bedroc"), obj.in_order("mask")]
        best = obj.pick(measured, ["a", "b", "how", "target"], *order)
        grown = best.filter("target = 1").select("a", "b", F.col("mask").alias("base"))
        out = best.join(self._of([c for c in CLASSICAL if c[0] != "greedy"]), ["how", "target"]).select("a", "b", "cid", "mask")
        greedy = self._of([c for c in CLASSICAL if c[0] == "greedy"])
        on = ["a", "b"]
        for size in SIZES:
            grown = measured.filter(F.col("target") == size).join(grown, on).filter(F.col("mask").bitwiseAND(F.col("base")) == F.col("base"))
            grown = obj.pick(grown, ["a", "b", "how"], *order).select("a", "b", "how", "target", F.col("mask").alias("base"))
            out = out.unionByName(grown.join(greedy, ["how", "target"]).select("a", "b", "cid", F.col("base").alias("mask")))
            grown, on = grown.drop("target"), ["a", "b", "how"]
        return out.join(self.roles, obj.CONTEXT).select("o", "i", "a", "b", "cid", "mask")

    def _trials(self, fits: DataFrame) -> DataFrame:
        """Mean validation metrics of each candidate over the inner folds."""
        seen = self.found.select("a", "b", F.col("part").alias("i"), "how", "mask", "bedroc", "average_precision", "roc_auc")
        rows = fits.filter("i <> o").join(F.broadcast(self.table), "cid").join(seen, ["a", "b", "i", "how", "mask"])  # table: a row for each setting
        mean = lambda c: F.round(F.avg(c), 8)
        return rows.groupBy("o", "cid", "family", "target", "how", sum(F.col(w) for w in obj.WEIGHTS).alias("weight")).agg(
            mean("bedroc").alias("inner_bedroc"), mean("average_precision").alias("inner_precision"), mean("roc_auc").alias("inner_auc"), F.round(F.stddev_pop("bedroc"), 6).alias("inner_spread")
        )

    def _first(self, trials: DataFrame) -> DataFrame:
        order = [F.desc("inner_bedroc"), F.desc("inner_precision"), F.desc("inner_auc"), F.asc_nulls_last("inner_spread"), "target", "weight", "cid"]
        return obj.pick(trials, ["o", "family"], *order)

    def _required(self, chosen: DataFrame) -> DataFrame:
        """Per outer fold the members that the inner subsets of the best coverage objective agree on, and the most frequent one."""
        inner = self.fits.filter("i <> o").join(chosen.filter("family = 'coverage'").select("o", "cid"), ["o", "cid"])
        times = inner.select("o", F.explode(obj.in_order("mask")).alias("member")).groupBy("o", "member").agg(F.count(F.lit(1)).alias("times"))
        folds_ = self.v.spark.createDataFrame([(o, sum(r[0] == o and r[1] != o for r in ROLES)) for o in range(-1, K)], "o int, folds int")
        stable = times.join(folds_, "o").filter(F.col("times") / F.col("folds") >= FREQUENCY - 1e-12)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("member"))
        all_ = folds_.join(stable.groupBy("o").agg(F.sum(bit).alias("required")), "o", "left").select("o", F.lit("consensus").alias("family"), F.coalesce("required", F.lit(0)).cast("long").alias("required"))
        core = obj.pick(stable, ["o"], F.desc("times"), "member").select("o", F.explode(F.array(F.lit("core_plus_one"), F.lit("core_plus_two"))).alias("family"), bit.alias("required"))
        return all_.unionByName(core)

    def chosen(self) -> DataFrame:
        """Per outer fold (-1: all rows) and family the best candidate with the subset that it fits there."""
        fitted = self.fits.filter("i = o").select("o", "cid", "a", "b", "mask")
        return self._first(self._trials(self.fits)).join(fitted, ["o", "cid"])

    def held_out(self) -> DataFrame:
        """``family, part, ligand_id, label, score``: what every family's choice of an outer fold gives the rows of that fold."""
        asked = folds.checkpointed(self.chosen().filter("o >= 0").select("family", "a", "b", F.col("o").alias("part"), "how", "mask"))
        kept = self.subsets.join(F.broadcast(asked.select("mask").distinct()), "mask", "left_semi")
        scored = obj.ensemble_scores(self.rows.filter("a = b and part = a and a >= 0"), kept, [*obj.CONTEXT, "part"])
        out = scored.join(F.broadcast(asked), [*obj.CONTEXT, "part", "how", "mask"])  # a row per family and fold
        return out.select("family", "part", "ligand_id", "label", "score")

    def pooled(self) -> DataFrame:
        """Held-out scores of every family's choices, pooled over the outer folds and ranked together; the best objective is ``selected``."""
        out = self.held_out()
        out = rounded(ranking.metrics(out, ["family"]), *DOUBLES)
        place = F.array_position(F.lit(OBJECTIVES), F.col("family"))
        order = obj.Window.partitionBy(place > 0).orderBy(F.desc("bedroc"), F.desc("average_precision"), F.desc("roc_auc"), place)
        return out.withColumn("selected", (place > 0) & (F.row_number().over(order) == 1))


_CHOSEN = f"family, how, {NAME} AS subset, inner_bedroc, inner_spread"


@query(f"WITH {FAMILY_SQL} SELECT w2.o AS outer_fold, w2.family, w2.how, {NAME.replace('mask', 'w2.mask')} AS subset, inner_bedroc, inner_spread, em.roc_auc, em.bedroc FROM w2 JOIN em ON em.xa = w2.o AND em.xb = w2.o AND em.part = w2.o AND em.how = w2.how AND em.mask = w2.mask WHERE w2.o >= 0")
def q_nested_families(v: Views) -> DataFrame:
    """What each family chose on the inner folds of each outer fold, and how that did on the fold held out."""
    n = Nested(v)
    seen = n.found.select("a", "b", F.col("part").alias("o"), "how", "mask", "roc_auc", "bedroc")
    out = n.chosen().filter("o >= 0").join(seen, ["a", "b", "o", "how", "mask"])
    return out.select(F.col("o").alias("outer_fold"), "family", "how", named().alias("subset"), "inner_bedroc", "inner_spread", "roc_auc", "bedroc")


@query(f"WITH {FAMILY_SQL} SELECT family, ligand_count, active_count, roc_auc, average_precision, bedroc, selected FROM sf")
def q_nested_family_oof(v: Views) -> DataFrame:
    return Nested(v).pooled().select("family", "ligand_count", "active_count", "roc_auc", "average_precision", "bedroc", "selected")


@query(f"WITH {FAMILY_SQL} SELECT w2.family, w2.target, w2.how, w2.weight, {NAME.replace('mask', 'w2.mask')} AS subset, inner_bedroc, w2.family IN (SELECT family FROM sf WHERE selected) AS selected FROM w2 WHERE o = -1")
def q_nested_family_final(v: Views) -> DataFrame:
    """The refit on all rows: each family's candidate by all folds as validation, fitted without a fold left out; the selected family's is the result."""
    n = Nested(v)
    selected = n.pooled().filter("selected").select("family", F.lit(True).alias("selected"))
    out = n.chosen().filter(F.col("o") == obj.FULL).join(F.broadcast(selected), "family", "left")  # one row
    return out.select("family", "target", "how", "weight", named().alias("subset"), "inner_bedroc", F.coalesce("selected", F.lit(False)).alias("selected"))

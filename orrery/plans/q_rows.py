"""Queries: scans, projections, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.functions import text as tx
from orrery.operators import relational as rel
from orrery.plans.registry import query
from orrery.plans.views import Views

# --- scans -------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, 'orders' AS origin FROM orders UNION ALL SELECT l_orderkey, 'lineitem' FROM lineitem")
def q_scan_union(v: Views) -> DataFrame:
    orders = v.table("orders", "o_orderkey").withColumnRenamed("o_orderkey", "id")
    lines = v.table("lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "id")
    return rel.tagged_union({"orders": orders, "lineitem": lines}, "origin")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS b FROM conversations) WHERE b = 0")
def q_first_block(v: Views) -> DataFrame:
    """Rows before the first marker of each block file: turns before the first answer."""
    turns = v.table("conversations", "conv_id", "turn", "role", "text")
    return tx.first_block(turns, ["conv_id"], ["turn", "role", "text"], F.col("role") == "assistant").select("conv_id", "turn", "role", "text")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{3,}')) AS INT) AS numbers, array_to_string(regexp_extract_all(text, '[0-9]{3,}'), ';') AS found FROM documents WHERE regexp_matches(text, '[0-9]{3,}')")
def q_regex_extract_all(v: Views) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[0-9]{3,}"), 0)
    docs = v.table("documents", "doc_id", "text").filter(F.col("text").rlike("[0-9]{3,}"))
    return docs.select("doc_id", F.size(found).alias("numbers"), F.array_join(found, ";").alias("found"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'the')) AS INT) AS warnings FROM documents")
def q_substring_count(v: Views) -> DataFrame:
    return v.table("documents", "doc_id", "text").select("doc_id", F.regexp_count("text", F.lit("the")).alias("warnings"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) IS NULL THEN 'no_k'
  WHEN CAST(json_extract_string(props, '$.k') AS INT) > 50 THEN 'k_above_limit' ELSE '' END AS exclusion_reasons FROM events""")
def q_json_flatten(v: Views) -> DataFrame:
    e = v.table("events", "event_id", "props").select("event_id", F.from_json("props", "k int").alias("p"))
    reasons = rel.reason_flags(no_k=F.col("p.k").isNull(), k_above_limit=F.col("p.k") > 50)
    return e.select("event_id", F.col("p.k").alias("k"), reasons.alias("exclusion_reasons"))


@query("SELECT DISTINCT path FROM (SELECT 'tables/' || n_name AS path FROM nation UNION ALL SELECT 'tables/' || r_name FROM region UNION ALL SELECT 'tables/README' ) ORDER BY path")
def q_manifest_union(v: Views) -> DataFrame:
    fixed = v.spark.createDataFrame([("tables/README",)], "path string")
    nations = v.table("nation").select(F.concat(F.lit("tables/"), "n_name").alias("path"))
    regions = v.table("region").select(F.concat(F.lit("tables/"), "r_name").alias("path"))
    return fixed.union(nations).union(regions).distinct().orderBy("path")


# --- projections and predicates --------------------------------------------------------


@query("SELECT ligand_id, receptor_id, -score AS ranking_score, CASE WHEN label = 'active' THEN 1 ELSE 0 END AS binary_label FROM scores")
def q_ranking_projection(v: Views) -> DataFrame:
    active = F.when(F.col("label") == "active", 1).otherwise(0).alias("binary_label")
    return v.scores.select("ligand_id", "receptor_id", (-F.col("score")).alias("ranking_score"), active)


@query("SELECT ligand_id, receptor_id, seed, pose_rank, docking_score FROM poses WHERE status = 'ok' AND docking_score IS NOT NULL")
def q_ok_filter(v: Views) -> DataFrame:
    ok = v.poses.filter("status = 'ok' and docking_score is not null")
    return ok.select("ligand_id", "receptor_id", "seed", "pose_rank", "docking_score")


@query("SELECT ligand_id, receptor_id, seed, docking_score FROM poses WHERE pose_rank = 1 AND status = 'ok'")
def q_rank1_filter(v: Views) -> DataFrame:
    """Rank as a number, so that 1 and 1.0 are the same."""
    first = v.poses.filter((F.col("pose_rank").cast("string").cast("double").cast("int") == 1) & (F.col("status") == "ok"))
    return first.select("ligand_id", "receptor_id", "seed", "docking_score")


REASONS = """(SELECT ligand_id, receptor_id, concat_ws(';', CASE WHEN hi - lo > 1 THEN 'seed_range_exceeded' END,
  CASE WHEN mid - lo > 1 THEN 'minimum_median_exceeded' END, CASE WHEN lo >= -200 THEN 'weak_minimum' END) AS reasons FROM replicates)"""


def _reasons(v: Views) -> DataFrame:
    return v.replicates.select(
        "ligand_id",
        "receptor_id",
        rel.reason_flags(
            seed_range_exceeded=F.col("hi") - F.col("lo") > 1,
            minimum_median_exceeded=F.col("mid") - F.col("lo") > 1,
            weak_minimum=F.col("lo") >= -200,
        ).alias("reasons"),
    )


@query(f"SELECT * FROM {REASONS}")
def q_reason_flags(v: Views) -> DataFrame:
    return _reasons(v)


@query(f"SELECT * FROM {REASONS} WHERE list_has_any(string_split(reasons, ';'), ['weak_minimum', 'other'])")
def q_reason_overlap(v: Views) -> DataFrame:
    wanted = F.array(F.lit("weak_minimum"), F.lit("other"))
    return _reasons(v).filter(F.arrays_overlap(F.split("reasons", ";"), wanted))


@query("""SELECT ligand_id, f AS flags, f <> '' AS needs_inspection FROM (SELECT ligand_id, concat_ws(';', CASE WHEN heavy_atoms > 45 THEN 'large' END,
  CASE WHEN weight > 1500 THEN 'heavy' END, CASE WHEN heavy_atoms < 5 THEN 'small' END) AS f FROM ligands)""")
def q_inspection_flags(v: Views) -> DataFrame:
    flags = rel.reason_flags(large=F.col("heavy_atoms") > 45, heavy=F.col("weight") > 1500, small=F.col("heavy_atoms") < 5)
    return v.ligands.select("ligand_id", flags.alias("flags")).withColumn("needs_inspection", F.col("flags") != "")


@query("""SELECT ligand_id, receptor_id, CASE WHEN hi - lo <= 10 THEN 'stable' WHEN mid - lo <= 10 THEN 'one_outlier' WHEN lo < -500 THEN 'strong_unstable' ELSE 'unstable' END AS class FROM replicates""")
def q_classify_ladder(v: Views) -> DataFrame:
    name = rel.ladder(
        (F.col("hi") - F.col("lo") <= 10, "stable"),
        (F.col("mid") - F.col("lo") <= 10, "one_outlier"),
        (F.col("lo") < -500, "strong_unstable"),
        otherwise="unstable",
    )
    return v.replicates.select("ligand_id", "receptor_id", name.alias("class"))


@query("SELECT ligand_id, printf('%s_%s_L%06d', group_id, label, ligand_id) AS long_id, printf('MK_A%04d', row_number() OVER (PARTITION BY label ORDER BY ligand_id)) AS short_id FROM ligands")
def q_id_format(v: Views) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("label").orderBy("ligand_id"))
    return v.ligands.select(
        "ligand_id",
        F.format_string("%s_%s_L%06d", "group_id", "label", "ligand_id").alias("long_id"),
        F.format_string("MK_A%04d", nth).alias("short_id"),
    )


@query(r"SELECT ligand_id, regexp_replace(name, '[^\p{L}\p{N}_-]', '_', 'g') AS file_name, coalesce(nullif(trim(group_id), ''), '_') || ':' || source_id AS residue_label, replace('a\b\' || name, '\', '/') AS path FROM ligands")
def q_name_cleaning(v: Views) -> DataFrame:
    return v.ligands.select(
        "ligand_id",
        tx.safe_file_name(F.col("name")).alias("file_name"),
        F.concat_ws(":", tx.blank_to(F.col("group_id"), "_"), "source_id").alias("residue_label"),
        tx.forward_slashes(F.concat(F.lit("a\\b\\"), "name")).alias("path"),
    )


@query("SELECT receptor_id, round(avg(s0), 6) AS primary_mean, round(min(s0), 6) AS primary_min, round(avg(lo), 6) AS sensitivity_mean, round(min(lo), 6) AS sensitivity_min FROM replicates GROUP BY receptor_id")
def q_flatten_struct(v: Views) -> DataFrame:
    bundle = lambda c: F.struct(F.round(F.avg(c), 6).alias("mean"), F.round(F.min(c), 6).alias("min"))
    nested = v.replicates.groupBy("receptor_id").agg(bundle("s0").alias("primary"), bundle("lo").alias("sensitivity"))
    return tx.flatten(nested, ["primary", "sensitivity"], ["receptor_id"])


@query("SELECT ligand_id, CAST(trunc(greatest(1, (0.24E0 * heavy_atoms + 0.29E0 * (heavy_atoms % 7) - 3.41E0) * 1.5E0)) AS INT) AS depth FROM ligands")
def q_heuristic_formula(v: Views) -> DataFrame:
    raw = (0.24 * F.col("heavy_atoms") + 0.29 * (F.col("heavy_atoms") % 7) - 3.41) * 1.5
    return v.ligands.select("ligand_id", F.greatest(F.lit(1.0), raw).cast("int").alias("depth"))


@query("""SELECT receptor_id, 'row_count' AS name, CAST(n AS DOUBLE) AS observed, 10.0E0 AS threshold, 'min' AS comparison, n >= 10 AS passed FROM (SELECT receptor_id, count(*) AS n FROM scores GROUP BY receptor_id)
UNION ALL SELECT receptor_id, 'best', m, -1.0E0, 'max', m <= -1 FROM (SELECT receptor_id, min(score) AS m FROM scores GROUP BY receptor_id)""")
def q_gate_check(v: Views) -> DataFrame:
    from orrery.operators.gates import check

    s = v.scores.groupBy("receptor_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.min("score").alias("m"))
    checks = F.array(check("row_count", F.col("n"), 10.0, "min"), check("best", F.col("m"), -1.0, "max"))
    return s.select("receptor_id", F.explode(checks).alias("c")).select("receptor_id", "c.*")


@query("SELECT ligand_id, len(list_filter(string_split(name, ' '), lambda x: regexp_matches(x, '^[a-m]'))) > 0 AS has_early FROM ligands")
def q_array_exists(v: Views) -> DataFrame:
    return v.ligands.select("ligand_id", F.exists(F.split("name", " "), lambda x: x.rlike("^[a-m]")).alias("has_early"))


# --- joins ---------------------------------------------------------------------------------


@query("SELECT ligand_id, receptor_id, a.s0, b.lo FROM replicates a JOIN replicates b USING (ligand_id, receptor_id)")
def q_strict_join(v: Views) -> DataFrame:
    keys = ["ligand_id", "receptor_id"]
    return rel.strict_join(v.replicates.select(*keys, "s0"), v.replicates.select(*keys, "lo"), keys)


@query("SELECT a.receptor_id AS a, b.receptor_id AS b, a.ligand_id, a.score AS score_a, b.score AS score_b, b.score - a.score AS delta FROM pair_scores a JOIN pair_scores b ON a.ligand_id = b.ligand_id AND a.receptor_id < b.receptor_id")
def q_shared_pair_join(v: Views) -> DataFrame:
    of = lambda r, n: v.pair_scores.select("ligand_id", F.col("receptor_id").alias(r), F.col("score").alias(n))
    both = of("a", "score_a").join(of("b", "score_b"), "ligand_id").filter("a < b")
    return both.withColumn("delta", F.col("score_b") - F.col("score_a"))


@query("SELECT ligand_id, receptor_id, seed, a.score AS reference_score, b.docking_score AS other_score, abs(a.score - b.docking_score) AS abs_delta FROM seed_scores a JOIN (SELECT * FROM poses WHERE pose_rank = 2) b USING (ligand_id, receptor_id, seed)")
def q_engine_pair_join(v: Views) -> DataFrame:
    second = v.poses.filter("pose_rank = 2").select("ligand_id", "receptor_id", "seed", F.col("docking_score").alias("other_score"))
    both = v.seed_scores.withColumnRenamed("score", "reference_score").join(second, ["ligand_id", "receptor_id", "seed"])
    return both.withColumn("abs_delta", F.abs(F.col("reference_score") - F.col("other_score")))


@query("SELECT receptor_id, ligand_id, rank, label, heavy_atoms FROM (SELECT receptor_id, ligand_id, CAST(row_number() OVER (PARTITION BY receptor_id ORDER BY score, ligand_id) AS INT) AS rank FROM scores) JOIN ligands USING (ligand_id) WHERE rank <= 5")
def q_lookup_join(v: Views) -> DataFrame:
    """Top hits with their properties; a hit that the manifest lacks is an error."""
    from orrery.operators.audit import require
    from orrery.operators.ranking import best

    top = best(v.scores.select("receptor_id", "ligand_id", "score"), ["receptor_id"], 5).drop("score")
    out = top.join(v.ligands.select("ligand_id", "label", "heavy_atoms"), "ligand_id", "left")
    return require(out, F.col("label").isNotNull(), "label")


@query("SELECT ligand_id, receptor_id, coalesce(b.score, a.score) AS score, CASE WHEN b.score IS NULL THEN 'base' ELSE 'replacement' END AS origin FROM pair_scores a LEFT JOIN (SELECT ligand_id, receptor_id, score FROM seed_scores WHERE seed = 2) b USING (ligand_id, receptor_id)")
def q_override_join(v: Views) -> DataFrame:
    new = v.seed_scores.filter("seed = 2")
    return rel.override(v.pair_scores, new, ["ligand_id", "receptor_id"], "score")


@query("""SELECT receptor_id, ligand_id, score, round(p.m, 6) AS parent_score, round(score - p.m, 6) AS delta FROM scores
  JOIN (SELECT receptor_id, avg(score) AS m FROM scores WHERE label = 'decoy' GROUP BY receptor_id) p USING (receptor_id)""")
def q_parent_delta(v: Views) -> DataFrame:
    parent = v.scores.filter("label = 'decoy'").groupBy("receptor_id").agg(F.avg("score").alias("p"))
    return v.scores.join(parent, "receptor_id").select(
        "receptor_id", "ligand_id", "score", F.round("p", 6).alias("parent_score"), F.round(F.col("score") - F.col("p"), 6).alias("delta")
    )


@query("SELECT w.ligand_id, w.r0, w.r1, w.r2, w.r3, w.r4, x.heavy_atoms AS extra FROM wide w JOIN ligands x ON x.ligand_id = w.ligand_id")
def q_matrix_merge(v: Views) -> DataFrame:
    return v.wide.select("ligand_id", "r0", "r1", "r2", "r3", "r4").join(v.ligands.select("ligand_id", F.col("heavy_atoms").alias("extra")), "ligand_id")


@query("SELECT w.ligand_id, w.r0, w.r1, s.score AS s2 FROM wide w LEFT JOIN (SELECT ligand_id, min(score) AS score FROM seed_scores WHERE seed = 2 GROUP BY ligand_id) s ON s.ligand_id = w.ligand_id")
def q_matrix_extend(v: Views) -> DataFrame:
    """New long columns beside a wide matrix: unpivot, union, pivot."""
    old = rel.unpivot_scores(v.wide.select("ligand_id", "r0", "r1"), ["ligand_id"], ["r0", "r1"], "column", "score")
    new = v.seed_scores.filter("seed = 2").groupBy("ligand_id").agg(F.min("score").alias("score")).withColumn("column", F.lit("s2"))
    new = new.join(v.wide.select("ligand_id"), "ligand_id", "left_semi")
    return rel.pivot_scores(old.unionByName(new), ["ligand_id"], "column", ["r0", "r1", "s2"], "score")


@query("SELECT * FROM pair_scores WHERE ligand_id IN (SELECT ligand_id FROM ligands WHERE split = 'train')")
def q_semi_subset(v: Views) -> DataFrame:
    return v.pair_scores.join(v.ligands.filter("split = 'train'").select("ligand_id"), "ligand_id", "left_semi")


@query("""WITH g AS (SELECT ligand_id, split, group_id || '-' || source_id AS group_id FROM ligands)
SELECT ligand_id, group_id FROM g WHERE group_id NOT IN (SELECT group_id FROM g WHERE split = 'test')""")
def q_group_anti_join(v: Views) -> DataFrame:
    """Rows whose group has not been consumed by the test split."""
    rows = v.ligands.select("ligand_id", "split", F.concat_ws("-", "group_id", "source_id").alias("group_id"))
    used = rows.filter("split = 'test'").select("group_id").distinct()
    return rows.drop("split").join(used, "group_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_new_rows_anti(v: Views) -> DataFrame:
    return v.table("documents", "doc_id").join(v.table("labels", "doc_id"), "doc_id", "left_anti")


@query("SELECT ligand_id, r_regionkey AS receptor_id FROM ligands, region")
def q_expected_grid(v: Views) -> DataFrame:
    return rel.expected_grid(v.ligands.select("ligand_id"), v.table("region").select(F.col("r_regionkey").alias("receptor_id")))


@query("""SELECT a.r AS a, b.r AS b FROM (SELECT DISTINCT receptor_id AS r FROM scores) a, (SELECT DISTINCT receptor_id AS r FROM scores) b WHERE a.r < b.r""")
def q_pair_self_join(v: Views) -> DataFrame:
    r = v.scores.select("receptor_id").distinct()
    a, b = r.withColumnRenamed("receptor_id", "a"), r.withColumnRenamed("receptor_id", "b")
    return a.join(b, F.col("a") < F.col("b"))


@query("SELECT ligand_id, receptor_id, max(CASE WHEN matrix_id = 'primary' THEN score END) - max(CASE WHEN matrix_id = 'sensitivity' THEN score END) AS delta FROM matrices GROUP BY ligand_id, receptor_id")
def q_paired_delta(v: Views) -> DataFrame:
    of = lambda m: F.max(F.when(F.col("matrix_id") == m, F.col("score")))
    return v.matrices.groupBy("ligand_id", "receptor_id").agg((of("primary") - of("sensitivity")).alias("delta"))


@query("""SELECT f.ligand_id, f.receptor_id, f.reasons, r.mid, l.label, l.group_id FROM """ + REASONS + """ f JOIN replicates r USING (ligand_id, receptor_id)
  JOIN ligands l USING (ligand_id) WHERE f.reasons <> ''""")
def q_case_resolution(v: Views) -> DataFrame:
    flagged = _reasons(v).filter("reasons <> ''")
    out = flagged.join(v.replicates.select("ligand_id", "receptor_id", "mid"), ["ligand_id", "receptor_id"])
    return out.join(v.ligands.select("ligand_id", "label", "group_id"), "ligand_id")


# --- set operations ----------------------------------------------------------------------------


@query("SELECT ligand_id, label FROM ligands WHERE split = 'train' UNION ALL SELECT ligand_id, label FROM ligands WHERE split = 'validation' UNION ALL SELECT ligand_id, label FROM ligands WHERE split = 'test'")
def q_disjoint_union(v: Views) -> DataFrame:
    of = lambda s: v.ligands.filter(F.col("split") == s).select("ligand_id", "label")
    return rel.disjoint_union([of("train"), of("validation"), of("test")], "ligand_id")


@query("SELECT receptor_id, ligand_id, 'seed0' AS origin FROM seed_scores WHERE seed = 0 UNION ALL SELECT receptor_id, ligand_id, 'seed1' FROM seed_scores WHERE seed = 1 UNION ALL SELECT receptor_id, ligand_id, 'seed2' FROM seed_scores WHERE seed = 2")
def q_tagged_union(v: Views) -> DataFrame:
    of = lambda s: v.seed_scores.filter(F.col("seed") == s).select("receptor_id", "ligand_id")
    return rel.tagged_union({"seed0": of(0), "seed1": of(1), "seed2": of(2)}, "origin")


@query("""SELECT (SELECT count(*) FROM (SELECT ligand_id FROM ligands WHERE split = 'train' INTERSECT SELECT ligand_id FROM ligands WHERE split = 'test')) AS shared,
  (SELECT count(*) FROM ligands WHERE split = 'validation') AS missing, 0 AS extra""")
def q_partition_audit(v: Views) -> DataFrame:
    from orrery.operators.audit import partition_audit

    of = lambda s: v.ligands.filter(F.col("split") == s).select("ligand_id")
    return partition_audit(of("train"), of("test"), v.ligands.select("ligand_id"), "ligand_id")


@query("SELECT ligand_id, CASE WHEN a.ligand_id IS NULL THEN 'b' ELSE 'a' END AS side FROM (SELECT DISTINCT ligand_id FROM seed_scores WHERE seed = 0) a FULL JOIN (SELECT DISTINCT ligand_id FROM seed_scores WHERE seed = 1) b USING (ligand_id) WHERE a.ligand_id IS NULL OR b.ligand_id IS NULL")
def q_key_set_diff(v: Views) -> DataFrame:
    of = lambda s: v.seed_scores.filter(F.col("seed") == s)
    return rel.key_difference(of(0), of(1), ["ligand_id"])


TOP_ACTIVE = """t AS (SELECT receptor_id, ligand_id FROM (SELECT *, row_number() OVER (PARTITION BY receptor_id ORDER BY score, ligand_id) AS r,
  count(*) OVER (PARTITION BY receptor_id) AS n FROM scores) WHERE r <= greatest(1, ceil(n * 0.1E0)) AND label = 'active'),
  s AS (SELECT r_regionkey AS receptor_id, list(ligand_id) FILTER (ligand_id IS NOT NULL) AS ids FROM region LEFT JOIN t ON t.receptor_id = r_regionkey GROUP BY 1),
  u AS (SELECT receptor_id, coalesce(ids, []) AS ids FROM s)"""
PAIRS = """p AS (SELECT a.receptor_id AS a, b.receptor_id AS b, a.ids AS x, b.ids AS y FROM u a JOIN u b ON a.receptor_id < b.receptor_id)"""


def top_active_sets(v: Views) -> DataFrame:
    from orrery.operators.ranking import ranked, top_count

    top = ranked(v.scores, ["receptor_id"], n="n")
    top = top.filter((F.col("rank") <= top_count(F.col("n"), 0.1)) & (F.col("label") == "active"))
    sets = top.groupBy("receptor_id").agg(F.collect_set("ligand_id").alias("ids"))
    every = v.table("region").select(F.col("r_regionkey").alias("receptor_id"))
    return every.join(sets, "receptor_id", "left").select("receptor_id", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))


def set_pairs(sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("receptor_id").alias("a"), F.col("ids").alias("x"))
    b = sets.select(F.col("receptor_id").alias("b"), F.col("ids").alias("y"))
    return a.join(b, F.col("a") < F.col("b"))


@query(f"WITH {TOP_ACTIVE}, {PAIRS} SELECT a, b, CAST(len(list_intersect(x, y)) AS INT) AS shared, CAST(len(x) + len(y) - len(list_intersect(x, y)) AS INT) AS union_count, CAST(len(x) - len(list_intersect(x, y)) AS INT) AS only_a, CAST(len(y) - len(list_intersect(x, y)) AS INT) AS only_b FROM p")
def q_active_coverage_pairs(v: Views) -> DataFrame:
    return set_pairs(top_active_sets(v)).select(
        "a",
        "b",
        F.size(F.array_intersect("x", "y")).alias("shared"),
        F.size(F.array_union("x", "y")).alias("union_count"),
        F.size(F.array_except("x", "y")).alias("only_a"),
        F.size(F.array_except("y", "x")).alias("only_b"),
    )


@query(f"WITH {TOP_ACTIVE}, {PAIRS} SELECT a, b, round(CASE WHEN len(x) + len(y) = 0 THEN 1.0E0 ELSE len(list_intersect(x, y)) * 1.0E0 / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS jaccard FROM p")
def q_pairwise_jaccard(v: Views) -> DataFrame:
    return set_pairs(top_active_sets(v)).select("a", "b", F.round(rel.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("SELECT split, upper(sha256(string_agg(x, chr(10) ORDER BY x))) AS id_hash, count(*) AS id_count FROM (SELECT DISTINCT split, CAST(ligand_id AS VARCHAR) AS x FROM ligands) GROUP BY split")
def q_id_set_hash(v: Views) -> DataFrame:
    return rel.id_set_hash(v.ligands, "ligand_id", ["split"])


# --- pivots ---------------------------------------------------------------------------------------


@query("SELECT * FROM wide")
def q_wide_matrix(v: Views) -> DataFrame:
    return v.wide


@query("SELECT ligand_id, 'r' || receptor_id AS receptor, score FROM scores")
def q_unpivot_matrix(v: Views) -> DataFrame:
    return rel.unpivot_scores(v.wide, ["ligand_id"], [f"r{i}" for i in range(5)], "receptor", "score")


@query("SELECT matrix_id, ligand_id, receptor_id, score FROM matrices")
def q_matrix_family(v: Views) -> DataFrame:
    return v.matrices.select("matrix_id", "ligand_id", "receptor_id", "score")


@query("SELECT cluster_id, " + ", ".join(f"round(avg(CASE WHEN point_id % 3 = {i} THEN {c} END), 6) AS g{i}__{c}" for i in range(3) for c in "xyz") + " FROM points GROUP BY cluster_id")
def q_feature_pivot(v: Views) -> DataFrame:
    """Features of several residues in one row per conformer."""
    means = [F.round(F.avg(c), 6).alias(c) for c in "xyz"]
    grouped = v.points.withColumn("g", (F.col("point_id") % 3).cast("int")).groupBy("cluster_id")
    p = grouped.pivot("g", [0, 1, 2]).agg(*means)
    return p.select("cluster_id", *[F.col(f"{i}_{c}").alias(f"g{i}__{c}") for i in range(3) for c in "xyz"])

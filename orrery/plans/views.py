"""Relations of the engine derived from the warehouse tables, as DataFrames and as SQL.

``Views`` builds each relation from Parquet with only the columns it needs; ``CTE`` holds
the equivalent SQL, and ``sql`` puts a query behind the relations that it names.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

RECEPTORS = (0, 1, 2, 3, 4)
SEEDS = (0, 1, 2)

#: Relations in order of dependence.
CTE: dict[str, str] = {
    "ligands": """
        SELECT p_partkey AS ligand_id, CASE WHEN p_size <= 10 THEN 'active' ELSE 'decoy' END AS label,
               CASE WHEN p_partkey % 10 < 6 THEN 'train' WHEN p_partkey % 10 < 8 THEN 'validation' ELSE 'test' END AS split,
               p_brand AS group_id, p_type AS source_id, p_size AS heavy_atoms, p_retailprice AS weight, p_name AS name
        FROM part""",
    "poses": """
        SELECT l_partkey AS ligand_id, n_regionkey AS receptor_id, l_linenumber % 3 AS seed,
               -floor(l_extendedprice / 100) / 100 AS docking_score,
               CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ok' END AS status,
               CAST(row_number() OVER (PARTITION BY l_partkey, n_regionkey, l_linenumber % 3
                 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_discount, l_tax) AS INT) AS pose_rank
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "seed_scores": """
        SELECT ligand_id, receptor_id, seed,
               coalesce(min(CASE WHEN pose_rank = 1 THEN docking_score END), min(docking_score)) AS score
        FROM poses WHERE status = 'ok' GROUP BY ligand_id, receptor_id, seed""",
    "pair_scores": """
        SELECT ligand_id, receptor_id, min(score) AS score FROM seed_scores GROUP BY ligand_id, receptor_id""",
    "scores": """
        SELECT s.ligand_id, s.receptor_id, s.score, l.label, l.split, l.group_id
        FROM pair_scores s JOIN ligands l ON s.ligand_id = l.ligand_id
        WHERE s.ligand_id IN (SELECT ligand_id FROM pair_scores GROUP BY ligand_id HAVING count(*) = 5)""",
    "wide": """
        SELECT ligand_id, label, split, group_id,
               max(CASE WHEN receptor_id = 0 THEN score END) AS r0, max(CASE WHEN receptor_id = 1 THEN score END) AS r1,
               max(CASE WHEN receptor_id = 2 THEN score END) AS r2, max(CASE WHEN receptor_id = 3 THEN score END) AS r3,
               max(CASE WHEN receptor_id = 4 THEN score END) AS r4
        FROM scores GROUP BY ligand_id, label, split, group_id""",
    "replicates": """
        SELECT ligand_id, receptor_id, max(CASE WHEN seed = 0 THEN score END) AS s0, max(CASE WHEN seed = 1 THEN score END) AS s1,
               max(CASE WHEN seed = 2 THEN score END) AS s2, min(score) AS lo, median(score) AS mid, max(score) AS hi
        FROM seed_scores GROUP BY ligand_id, receptor_id HAVING count(*) = 3""",
    "matrices": """
        SELECT matrix_id, ligand_id, receptor_id, score, label, split, group_id FROM (
          SELECT 'primary' AS matrix_id, ligand_id, receptor_id, mid AS score FROM replicates
          UNION ALL SELECT 'sensitivity', ligand_id, receptor_id, lo FROM replicates
          UNION ALL SELECT 'seed0', ligand_id, receptor_id, s0 FROM replicates
          UNION ALL SELECT 'seed1', ligand_id, receptor_id, s1 FROM replicates
          UNION ALL SELECT 'seed2', ligand_id, receptor_id, s2 FROM replicates) m JOIN ligands USING (ligand_id)""",
    "frames": """
        SELECT user_id AS run_id, event_type AS cluster_id, value,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS frame
        FROM events""",
    "points": """
        SELECT vec_id AS point_id, label AS cluster_id, CAST(embedding[{1}] AS DOUBLE) AS x, CAST(embedding[{2}] AS DOUBLE) AS y,
               CAST(embedding[{3}] AS DOUBLE) AS z FROM embeddings WHERE embedding IS NOT NULL""".replace("{1}", "1").replace("{2}", "2").replace("{3}", "3"),
}


def sql(body: str) -> str:
    """``body`` behind the relations that it, or they, mention."""
    wanted: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTE:
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b|,\s*{name}\s+[a-z]\b", text):
                wanted.add(name)
                todo.append(CTE[name])
    head = ", ".join(f"{name} AS ({text})" for name, text in CTE.items() if name in wanted)
    body = body.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


class Views:
    """The relations over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.select(*columns) if columns else df

    @cached_property
    def ligands(self) -> DataFrame:
        part = self.table("part", "p_partkey", "p_size", "p_brand", "p_type", "p_retailprice", "p_name")
        tenth = F.col("p_partkey") % 10
        return part.select(
            F.col("p_partkey").alias("ligand_id"),
            F.when(F.col("p_size") <= 10, "active").otherwise("decoy").alias("label"),
            F.when(tenth < 6, "train").when(tenth < 8, "validation").otherwise("test").alias("split"),
            F.col("p_brand").alias("group_id"),
            F.col("p_type").alias("source_id"),
            F.col("p_size").alias("heavy_atoms"),
            F.col("p_retailprice").alias("weight"),
            F.col("p_name").alias("name"),
        )

    @cached_property
    def poses(self) -> DataFrame:
        """One row per scored alternative. Dimension tables are left to the planner to broadcast by size."""
        lines = self.table(
            "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_quantity", "l_discount", "l_tax"
        )
        where = self.table("supplier", "s_suppkey", "s_nationkey").join(
            self.table("nation", "n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        seed = (F.col("l_linenumber") % 3).alias("seed")
        order = Window.partitionBy("l_partkey", "n_regionkey", F.col("l_linenumber") % 3).orderBy(
            F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax"
        )
        return lines.join(where, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.col("l_partkey").alias("ligand_id"),
            F.col("n_regionkey").alias("receptor_id"),
            seed,
            (-F.floor(F.col("l_extendedprice") / 100).cast("double") / 100).alias("docking_score"),
            F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"),
            F.row_number().over(order).alias("pose_rank"),
        )

    @cached_property
    def seed_scores(self) -> DataFrame:
        from orrery.operators.relational import representative

        return representative(self.poses, ["ligand_id", "receptor_id", "seed"]).filter("status = 'ok'").select(
            "ligand_id", "receptor_id", "seed", F.col("representative_score").alias("score")
        )

    @cached_property
    def pair_scores(self) -> DataFrame:
        return self.seed_scores.groupBy("ligand_id", "receptor_id").agg(F.min("score").alias("score"))

    @cached_property
    def scores(self) -> DataFrame:
        """Scores of the ligands that have one for every receptor, with their labels."""
        from orrery.operators.folds import checkpointed

        n = F.count(F.lit(1)).over(Window.partitionBy("ligand_id"))
        full = self.pair_scores.withColumn("n", n).filter(F.col("n") == len(RECEPTORS)).drop("n")
        # Written once: every branch of a query reads it, and few would be pruned to less.
        return checkpointed(full.join(self.ligands.select("ligand_id", "label", "split", "group_id"), "ligand_id"))

    @cached_property
    def wide(self) -> DataFrame:
        from orrery.operators.relational import pivot_scores

        out = pivot_scores(self.scores, ["ligand_id", "label", "split", "group_id"], "receptor_id", RECEPTORS, "score")
        return out.select("ligand_id", "label", "split", "group_id", *[F.col(str(r)).alias(f"r{r}") for r in RECEPTORS])

    @cached_property
    def replicates(self) -> DataFrame:
        from orrery.operators.relational import seed_aggregate

        return seed_aggregate(self.seed_scores, ["ligand_id", "receptor_id"], "seed", SEEDS, "score")

    @cached_property
    def matrices(self) -> DataFrame:
        """Five parallel matrices in long form, told apart by ``matrix_id``."""
        names = {"mid": "primary", "lo": "sensitivity", "s0": "seed0", "s1": "seed1", "s2": "seed2"}
        long = self.replicates.unpivot(["ligand_id", "receptor_id"], list(names), "which", "score")
        name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("which")]
        return long.select(name.alias("matrix_id"), "ligand_id", "receptor_id", "score").join(
            self.ligands.select("ligand_id", "label", "split", "group_id"), "ligand_id"
        )

    @cached_property
    def frames(self) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events", "user_id", "event_type", "value", "ts", "event_id").select(
            F.col("user_id").alias("run_id"), F.col("event_type").alias("cluster_id"), "value", F.row_number().over(order).alias("frame")
        )

    @cached_property
    def points(self) -> DataFrame:
        e = self.table("embeddings", "vec_id", "embedding", "label").filter("embedding is not null")
        xyz = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
        return e.select(F.col("vec_id").alias("point_id"), F.col("label").alias("cluster_id"), *xyz)

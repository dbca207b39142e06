"""Pockets of expected residues: completeness, eligibility with reasons, and features with missing residues filled in.

The expected residues, with the reference's names and coordinates, are a small table. Every
structure meets them by its residues' numbers, so the work grows with structures times
expected residues.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def against_reference(residues: DataFrame, reference: DataFrame, structure: str = "structure_id") -> DataFrame:
    """``structure, residue, state, x, y, z`` of every expected residue in every structure.

    ``residues``: structure, residue, name, x, y, z; ``reference``: residue, name, x, y, z. A
    residue is present where its name is the reference's, else mismatched or missing; then
    the coordinates are the reference's. Structures without any expected residue count too.
    """
    want = F.broadcast(reference.select("residue", F.col("name").alias("__name"), *[F.col(c).alias(f"__{c}") for c in "xyz"]))
    every = residues.select(structure).distinct().crossJoin(want)
    both = every.join(residues.select(structure, "residue", "name", *"xyz"), [structure, "residue"], "left")
    state = F.when(F.col("name").isNull(), "missing").when(F.col("name") != F.col("__name"), "mismatched").otherwise("present")
    own = F.col("state") == "present"
    out = both.withColumn("state", state)
    return out.select(structure, "residue", "state", *[F.when(own, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in "xyz"])


def eligibility(matched: DataFrame, anchors: list, least_share: float, structure: str = "structure_id") -> DataFrame:
    """Per structure how much of the pocket is there, what is not, why it is excluded, and how many residues would be filled in."""
    of = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(s, F.col("residue")))), ";")
    state = F.col("state")
    out = matched.groupBy(structure).agg(
        F.count_if(state == "present").alias("present"),
        (F.count_if(state == "present") / F.count(F.lit(1))).alias("share"),
        of(state == "missing").alias("missing"),
        of(state == "mismatched").alias("mismatched"),
        of((state != "present") & F.col("residue").isin(anchors)).alias("missing_anchors"),
        F.count_if(state != "present").alias("imputed"),
    )
    reasons = F.concat_ws(
        ";",
        F.when(F.col("share") < least_share, "pocket_share_below_limit"),
        F.when(F.col("mismatched") != "", "pocket_name_mismatch"),
        F.when(F.col("missing_anchors") != "", "missing_anchor"),
    )
    return out.withColumn("reasons", reasons).withColumn("eligible", F.col("reasons") == "")


def features(matched: DataFrame, eligible: DataFrame, structure: str = "structure_id") -> DataFrame:
    """``structure, a, b, distance, imputed``: distances of all pairs of expected residues in eligible structures, the filled ones being told."""
    kept = matched.join(eligible.filter("eligible").select(structure), structure, "left_semi")
    side = lambda p: kept.select(structure, F.col("residue").alias(p), (F.col("state") != "present").alias(f"{p}_filled"), *[F.col(c).alias(f"{p}_{c}") for c in "xyz"])
    both = side("a").join(side("b"), structure).filter("a < b")
    d = F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) ** 2 for c in "yz"), (F.col("a_x") - F.col("b_x")) ** 2))
    return both.select(structure, "a", "b", d.alias("distance"), (F.col("a_filled") | F.col("b_filled")).alias("imputed"))

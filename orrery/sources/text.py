"""Line-oriented formats: whitespace records, key=value files, fixed-width coordinates, logs.

Small files are read whole, one row per file, so that lines keep their numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.operators.audit import require


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_number, line`` of text files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r?\n$", "").alias("v"))
    return whole.select("path", F.posexplode(F.split("v", "\r?\n")).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_number"), "line")


def read_ism(spark: SparkSession, path: str) -> DataFrame:
    """``smiles, source_molecule_id, source_extra_id, source_line_number``; a line with one field fails."""
    fields = F.split(F.trim("line"), r"\s+")
    rows = lines(spark, path).filter(F.trim("line") != "").withColumn("f", fields)
    rows = require(rows, F.size("f") >= 2, "molecule id")
    return rows.select(
        F.col("f")[0].alias("smiles"),
        F.col("f")[1].alias("source_molecule_id"),
        F.get("f", F.lit(2)).alias("source_extra_id"),
        F.col("line_number").alias("source_line_number"),
    )


def read_key_values(spark: SparkSession, path: str, required: Sequence[str] = ()) -> dict[str, str]:
    """A ``key = value`` file with # comments, whole; it goes to the driver as a configuration."""
    body = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines(spark, path).select(body.alias("b")).filter(F.col("b").contains("="))
    pair = F.split("b", "=", 2)
    found = {r[0]: r[1] for r in rows.select(F.trim(pair[0]), F.trim(pair[1])).collect()}
    if missing := [k for k in required if k not in found]:
        raise ValueError(f"missing keys: {', '.join(missing)}")
    return found


def column(line: Column, first: int, last: int) -> Column:
    """Characters first to last-1, from 0, trimmed; null if blank."""
    return F.nullif(F.trim(F.substring(line, first + 1, last - first)), F.lit(""))


def parse_pdb(rows: DataFrame, keys: Sequence[str] = ("path",), first_model: bool = True) -> DataFrame:
    """Atoms from fixed-width records; of several models only the first, if asked for.

    The element falls back to the first letter of the atom's name.
    """
    line = F.col("line")
    if first_model:
        w = Window.partitionBy(*keys).orderBy("line_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("__m", F.sum(F.when(line.startswith("MODEL"), 1).otherwise(0)).over(w)).filter("__m <= 1")
    atoms = rows.filter(line.startswith("ATOM") | line.startswith("HETATM"))
    name = column(line, 12, 16)
    return atoms.select(
        *keys,
        "line_number",
        column(line, 0, 6).alias("record"),
        column(line, 6, 11).try_cast("int").alias("serial"),
        name.alias("atom_name"),
        F.coalesce(column(line, 16, 17), F.lit("")).alias("altloc"),
        column(line, 17, 20).alias("resname"),
        column(line, 21, 22).alias("chain"),
        column(line, 22, 26).cast("int").alias("resseq"),
        F.coalesce(column(line, 26, 27), F.lit("")).alias("icode"),
        column(line, 30, 38).cast("double").alias("x"),
        column(line, 38, 46).cast("double").alias("y"),
        column(line, 46, 54).cast("double").alias("z"),
        F.coalesce(column(line, 54, 60).try_cast("double"), F.lit(1.0)).alias("occupancy"),
        F.coalesce(column(line, 76, 78), F.regexp_extract(name, "([A-Za-z])", 1)).alias("element"),
    )


def format_pdb(atoms: DataFrame) -> DataFrame:
    """Atoms as fixed-width lines again."""
    line = F.format_string(
        "%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f",
        "record", "serial", "atom_name", "altloc", "resname", "chain", "resseq", "icode", "x", "y", "z", "occupancy",
    )
    return atoms.select(line.alias("value"))


def summarize_pdbqt(rows: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Atom count, charge range, atom types and torsional degrees of freedom per file."""
    line = F.col("line")
    is_atom = line.startswith("ATOM") | line.startswith("HETATM")
    charge = F.when(is_atom, F.trim(F.substring(line, 69, 8)).try_cast("double"))
    kind = F.when(is_atom, F.trim(F.substring(line, 78, 2)))
    torsions = F.when(line.startswith("TORSDOF"), F.element_at(F.split(F.trim(line), r"\s+"), 2).cast("int"))
    return rows.groupBy(*keys).agg(
        F.count_if(is_atom).alias("atom_count"),
        F.min(charge).alias("charge_min"),
        F.max(charge).alias("charge_max"),
        F.array_join(F.array_sort(F.collect_set(kind)), ";").alias("atom_types"),
        F.max(torsions).alias("torsdof"),
    )


def score_table(rows: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Rows of four numbers (mode, score, two distances) in an engine's output; others are skipped."""
    f = F.split(F.trim("line"), r"\s+")
    values = [F.get(f, F.lit(i)).try_cast("double") for i in range(4)]
    good = (F.size(f) == 4) & F.get(f, F.lit(0)).rlike("^[0-9]+$")
    for v in values:
        good = good & v.isNotNull()
    names = "docking_score", "rmsd_lower", "rmsd_upper"
    return rows.filter(good).select(*keys, values[0].cast("int").alias("pose_rank"), *[v.alias(n) for v, n in zip(values[1:], names, strict=True)])


def single_score(rows: DataFrame, pattern: str, keys: Sequence[str] = ("path",)) -> DataFrame:
    """The one number that a pattern's group finds in each file; none or several fail."""
    found = rows.select(*keys, F.explode(F.regexp_extract_all("line", F.lit(pattern), 1)).alias("s")).groupBy(*keys).agg(F.collect_list("s").alias("s"))
    every = rows.select(*keys).distinct().join(found, list(keys), "left")
    one = require(every, F.size(F.coalesce("s", F.array())) == 1, "single score")
    return one.select(*keys, F.col("s")[0].cast("double").alias("score"))

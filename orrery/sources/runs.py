"""Earlier runs and their results: discovery, recovery, progress, packages and short reports.

A run is a folder with a ``summary.json`` that names a CSV beside it and the SHA-256 of its
bytes. Files are read by Spark, so they may lie in any store that it reaches; what one run
writes about itself (progress, a report) is a small local file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """``run, csv, sha256, found_sha256, intact`` of the run folders that match a glob pattern.

    ``intact`` is false where the CSV is missing or its bytes have another hash.
    """
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    summaries = spark.read.option("multiLine", True).schema("csv string, sha256 string").json(f"{pattern}/summary.json")
    told = summaries.select(plain(folder(F.col("_metadata.file_path"))).alias("run"), "csv", "sha256")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(pattern)
    found = files.select(plain(folder("path")).alias("run"), F.regexp_extract("path", "([^/]*)$", 1).alias("csv"), F.sha2("content", 256).alias("found_sha256"))
    out = told.join(found, ["run", "csv"], "left")
    return out.withColumn("intact", F.coalesce(F.col("sha256") == F.col("found_sha256"), F.lit(False)))


def load_intact(spark: SparkSession, runs: DataFrame, schema: str) -> DataFrame:
    """The rows of all runs; one that is not intact is an error."""
    rows = runs.select("run", "csv", "intact").collect()  # one row a run
    if broken := sorted(r["run"] for r in rows if not r["intact"]):
        raise ValueError(f"runs without an intact table: {', '.join(broken)}")
    if not rows:
        raise ValueError("no runs found")
    return spark.read.schema(schema).option("header", True).csv([f"{r['run']}/{r['csv']}" for r in rows])


def recovered(path: str, parse: Callable[[str], object]) -> object | None:
    """What ``parse`` makes of an earlier file, or None where there is none or it is not valid."""
    try:
        text = Path(path).read_text(encoding="utf-8")
        return parse(text) if text.strip() else None
    except (OSError, ValueError):
        return None


def replace_json(path: str, value: object) -> None:
    """Write JSON such that readers see either the old file or the new one, whole."""
    part = f"{path}.part"
    with open(part, "w", encoding="ascii") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def package(path: str, root: str, required: Sequence[str], rows: Mapping[str, int] | None = None) -> list[str]:
    """Pack the required files below ``root``; nothing is written if one is missing, empty or short of rows.

    ``rows`` gives the data rows that a CSV must have.
    """
    from orrery.sources.tables import bundle

    wrong = []
    for name in sorted(set(required)):
        file = Path(root, name)
        if not file.is_file() or not file.stat().st_size:
            wrong.append(f"{name}: missing or empty")
        elif rows and name in rows and (n := sum(1 for x in file.open(encoding="utf-8") if x.strip()) - 1) != rows[name]:
            wrong.append(f"{name}: {n} rows of {rows[name]}")
    if wrong:
        raise ValueError("; ".join(wrong))
    bundle(path, {name: (Path(root, name).stat().st_size, lambda name=name: Path(root, name).open("rb")) for name in required})
    return sorted(set(required))


def markdown_report(title: str, facts: Mapping[str, object], table: DataFrame | None = None, most: int = 200) -> str:
    """A short report: a title, facts as a list and, if given, the first rows of a table."""
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in facts.items())]
    if table is not None:
        cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|")
        lines += ["", "| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
        rows = table.limit(most + 1).collect()
        lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
        if len(rows) > most:
            lines += ["", f"Only the first {most} rows are shown."]
    return "\n".join(lines) + "\n"

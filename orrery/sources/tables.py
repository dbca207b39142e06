"""CSV and JSON tables in and out. Blank cells are null inside and blank again outside."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """A table lacks required columns, or has no rows."""


def read_csv(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str] = (), allow_empty: bool = False) -> DataFrame:
    """One or more CSV files with headers, as strings, united by column name.

    Files may have extra columns; those that a file lacks are null. Missing required
    columns and, unless allowed, an empty result are errors.
    """
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        df = spark.read.option("header", True).option("nullValue", "").csv(path)
        if missing := [c for c in required if c not in df.columns]:
            raise SchemaError(f"{path} lacks columns: {', '.join(missing)}")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None or (not allow_empty and out.isEmpty()):
        raise SchemaError("no rows")
    return out


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Only one split of a Parquet table: the filter reaches the scan."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def read_cells(spark: SparkSession, path: str, ids: DataFrame, id_: str, column: str) -> DataFrame:
    """One score column for the given ids only; no other column is read."""
    return spark.read.parquet(path).select(id_, "label", column).join(ids.select(id_).distinct(), id_, "left_semi")


def read_json_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_config(path: str, required: Sequence[str]) -> dict:
    """A JSON configuration on the driver, with its required keys checked."""
    config = json.loads(Path(path).read_text())
    if missing := [k for k in required if k not in config]:
        raise SchemaError(f"{path} lacks keys: {', '.join(missing)}")
    return config


def config_difference(a: dict, b: dict) -> list[str]:
    """Keys in which two configurations differ."""
    return sorted(k for k in {*a, *b} if a.get(k) != b.get(k) or (k in a) != (k in b))


def write_csv(df: DataFrame | Sequence[DataFrame], path: str, overwrite: bool = False, allow_empty: bool = True) -> None:
    """CSV with a header; several frames are written under the union of their columns.

    An existing output is an error unless ``overwrite`` is set.
    """
    frames = [df] if isinstance(df, DataFrame) else list(df)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if not allow_empty and out.isEmpty():
        raise SchemaError("nothing to write")
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_summary(df: DataFrame, path: str, overwrite: bool = False) -> dict:
    """A frame of one row as sorted, indented JSON; the file is replaced in one step."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise SchemaError("a summary has exactly one row")
    target = Path(path)
    if target.exists() and not overwrite:
        raise FileExistsError(path)
    summary = rows[0].asDict(recursive=True)
    half = target.with_suffix(".tmp")
    half.write_text(json.dumps(summary, indent=2, sort_keys=True, ensure_ascii=True, default=str) + "\n")
    half.replace(target)
    return summary


def write_once(df: DataFrame, path: str, marker: str) -> None:
    """Write a result that may be made once only: the marker is set before anything is read."""
    Path(marker).open("x").close()
    df.write.mode("errorifexists").parquet(path)


def file_manifest(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, size_bytes, sha256`` of files, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def bundle(path: str, members: Mapping[str, tuple[int, Callable]]) -> str:
    """A tar.gz that depends on its members alone (sorted names, no times or owners); its SHA-256.

    ``members`` has the size of each and what opens it. They are read one after the other, so
    that none has to fit in memory.
    """
    import gzip
    import hashlib
    import tarfile

    with open(path, "wb") as out, gzip.GzipFile(filename="", fileobj=out, mode="wb", mtime=0) as packed, tarfile.open(fileobj=packed, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name in sorted(members):
            info = tarfile.TarInfo(name)
            info.size, opened = members[name]
            with opened() as data:
                tar.addfile(info, data)
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_bundle(members: dict[str, bytes], path: str) -> str:
    """As ``bundle``, of members that are at hand."""
    import io

    return bundle(path, {name: (len(data), lambda data=data: io.BytesIO(data)) for name, data in members.items()})

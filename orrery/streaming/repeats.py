"""Repeated runs that go on where they were left.

Results lie in one folder of shared storage: ``results`` in Parquet, a partition for each
configuration's hash, and ``catalog`` with a row for each finished configuration. A row is
added after its results are written and read back, and holds their fingerprint; so a run that
dies in between is open again, and so is one whose stored rows are no longer what they were.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "config_hash string, n long, one decimal(38,0), two decimal(38,0)"


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(dict(config), sort_keys=True).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _signed(results: DataFrame) -> DataFrame:
    """Per configuration the rows and two sums of row hashes."""
    fields = [F.col(f"`{c}`") for c in sorted(results.columns) if c != "config_hash"]
    sums = [F.sum(F.xxhash64(F.lit(s), *fields).cast("decimal(38,0)")).cast("decimal(38,0)").alias(n) for s, n in ((1, "one"), (2, "two"))]
    return results.groupBy("config_hash").agg(F.count(F.lit(1)).alias("n"), *sums)


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """``config_hash`` of the configurations whose stored rows are those that the catalog recorded."""
    if not _exists(spark, f"{folder}/catalog") or not _exists(spark, f"{folder}/results"):
        return spark.createDataFrame([], "config_hash string")
    stored = _signed(spark.read.parquet(f"{folder}/results"))
    return spark.read.schema(CATALOG).parquet(f"{folder}/catalog").join(stored, ["config_hash", "n", "one", "two"], "left_semi").select("config_hash").distinct()


def run_repeats(spark: SparkSession, folder: str, configs: Sequence[Mapping], schema: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    """Results of all ``configs``, of which only the open ones are computed, and the hashes of these.

    ``compute`` gets the open configurations as a table of ``schema`` and ``config_hash``, all at
    once, and returns rows with ``config_hash``. Stored rows of open configurations are replaced.
    """
    by_hash = {config_hash(c): dict(c) for c in configs}
    done = {r["config_hash"] for r in finished(spark, folder).filter(F.col("config_hash").isin(list(by_hash))).collect()}  # one row a configuration
    todo = [h for h in by_hash if h not in done]
    if todo:
        table = spark.createDataFrame([(*by_hash[h].values(), h) for h in todo], f"{schema}, config_hash string")
        writer = compute(table).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("config_hash").parquet(f"{folder}/results")
        written = spark.read.parquet(f"{folder}/results").filter(F.col("config_hash").isin(todo))
        _signed(written).select([x.split()[0] for x in CATALOG.split(", ")]).write.mode("append").parquet(f"{folder}/catalog")
    out = spark.read.parquet(f"{folder}/results").filter(F.col("config_hash").isin(list(by_hash)))
    return out, todo

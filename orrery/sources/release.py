"""A protocol is frozen, and its locked rows are evaluated once.

The states lie as small JSON files in one folder of a store that Spark reaches:

    open -> frozen (``frozen.json``) -> consumed (``consumed.json``) -> released (``summary.json``)

Each file is created in one step that fails if it exists, so of two runs that race only one
goes on. The consumed marker is written before the first locked row is read. A run that dies
after that leaves the state ``consumed``: nothing may be evaluated again, however little
came out of it. Freezing records a fingerprint of every input table; a release checks them first.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ReleaseError(RuntimeError):
    """The state of the folder, or an input, forbids the step."""


def table_fingerprint(df: DataFrame) -> str:
    """SHA-256 of the columns, the number of rows and two sums of row hashes: the same for the same rows in any order."""
    fields = [F.col(f"`{c}`") for c in sorted(df.columns)]
    sums = [F.sum(F.xxhash64(F.lit(s), *fields, *[c.isNull() for c in fields]).cast("decimal(38,0)")) for s in (1, 2)]
    found = df.agg(F.count(F.lit(1)), *sums).first()
    kinds = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return hashlib.sha256(json.dumps([kinds, [str(x) for x in found]]).encode()).hexdigest()


def _canonical(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=True) + "\n"


class Release:
    """The one-time release in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def _create(self, name: str, value: object) -> str:
        """Write a new file whole; its SHA-256. An existing one is an error."""
        text = _canonical(value)
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:
            if self._fs.exists(self._at(name)):
                raise ReleaseError(f"{name} exists already") from e
            raise
        try:
            out.write(bytearray(text.encode("ascii")))
            out.hflush()
        finally:
            out.close()
        return hashlib.sha256(text.encode("ascii")).hexdigest()

    def _read(self, name: str) -> tuple[dict, str]:
        raw = bytes(self.spark.read.format("binaryFile").load(f"{self.folder}/{name}").select("content").first()[0])
        return json.loads(raw), hashlib.sha256(raw).hexdigest()

    def state(self) -> str:
        for name, state in (("summary.json", "released"), ("consumed.json", "consumed"), ("frozen.json", "frozen")):
            if self._fs.exists(self._at(name)):
                return state
        return "open"

    def freeze(self, protocol: Mapping, inputs: Mapping[str, DataFrame]) -> str:
        """Fix the protocol and what its inputs hold; the hash that a release must name."""
        if (state := self.state()) != "open":
            raise ReleaseError(f"cannot freeze what is {state}")
        return self._create("frozen.json", {"protocol": dict(protocol), "inputs": {k: table_fingerprint(df) for k, df in sorted(inputs.items())}})

    def release(self, frozen_sha256: str, inputs: Mapping[str, DataFrame], evaluate: Callable[[dict], DataFrame], authorized: bool = False) -> DataFrame:
        """Evaluate the frozen protocol on its locked rows, once, and keep the result in the folder.

        ``evaluate`` gets the protocol and is called after the marker is set; what it returns is
        written as ``result`` and read back.
        """
        if not authorized:
            raise ReleaseError("a release must be authorized")
        if (state := self.state()) != "frozen":
            raise ReleaseError(f"cannot release what is {state}")
        frozen, found = self._read("frozen.json")
        if found != frozen_sha256:
            raise ReleaseError("the frozen protocol is not the one that is named")
        if set(inputs) != set(frozen["inputs"]):
            raise ReleaseError("inputs are not those that were frozen")
        if changed := sorted(k for k, df in inputs.items() if table_fingerprint(df) != frozen["inputs"][k]):
            raise ReleaseError(f"inputs changed since the freeze: {', '.join(changed)}")
        marker = self._create("consumed.json", {"status": "consumed", "frozen_sha256": found})
        evaluate(frozen["protocol"]).write.mode("errorifexists").parquet(f"{self.folder}/result")
        result = self.spark.read.parquet(f"{self.folder}/result")
        self._create("summary.json", {"status": "released", "frozen_sha256": found, "consumed_sha256": marker, "result": table_fingerprint(result), "rows": result.count()})
        return result


def locked_audit(matrix: DataFrame, manifest: DataFrame, id_: str, label: str, score: str, split: str, locked: str) -> DataFrame:
    """``violation, n`` of a one-column score matrix against its manifest, over all rows but reading scores of locked ones only.

    ``matrix`` has the id, the label and one score; other columns are not read. Counted are
    ids that repeat, ids that the manifest lacks, ids that the matrix lacks, labels that
    differ, and locked rows whose score is missing or not finite.
    """
    m = matrix.groupBy(id_).agg(F.count(F.lit(1)).alias("__n"), F.min(label).alias("__lo"), F.max(label).alias("__hi"), F.max(score).alias("__s"), F.count(score).alias("__c"))
    both = m.join(manifest.select(F.col(id_), F.col(label).alias("__want"), F.col(split).alias("__split"), F.lit(True).alias("__known")), id_, "full")
    seen, known = F.col("__n").isNotNull(), F.coalesce("__known", F.lit(False))
    lock = known & (F.col("__split") == locked)
    finite = (F.col("__c") > 0) & ~F.isnan("__s") & (F.abs("__s") < float("inf"))
    tests = {
        "repeated_id": F.coalesce(F.col("__n") > 1, F.lit(False)),
        "unknown_id": seen & ~known,
        "missing_id": known & ~seen,
        "label_differs": seen & known & ~((F.col("__lo") == F.col("__want")) & (F.col("__hi") == F.col("__want"))),
        "locked_score_unusable": lock & seen & ~F.coalesce(finite, F.lit(False)),
        "locked_missing": lock & ~seen,
    }
    counts = both.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return counts.unpivot([], list(tests), "violation", "n")


def read_locked(matrix: DataFrame, manifest: DataFrame, id_: str, label: str, score: str, split: str, locked: str) -> DataFrame:
    """Id, label and the one score of the locked rows; any violation of ``locked_audit`` is an error."""
    bad = {r["violation"]: r["n"] for r in locked_audit(matrix, manifest, id_, label, score, split, locked).collect() if r["n"]}  # six rows
    if bad:
        raise ReleaseError("; ".join(f"{k}: {v}" for k, v in sorted(bad.items())))
    return matrix.select(id_, label, score).join(manifest.filter(F.col(split) == locked).select(id_), id_, "left_semi")

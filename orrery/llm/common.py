"""Shared helpers: cutting lineage, size-checked broadcasts, word patterns, worker caches."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side is broadcast only if its rows, counted and weighed, hold no more bytes than this.
BROADCAST_BYTES = 32 << 20
#: The same for lists of keys, which the driver holds several times over while it builds them; bits of a bitmap that stands for a longer one.
LISTED_BYTES, MARKS = 2 << 20, 1 << 25
#: Copies of a row that one task makes at a time.
COPIES = 1 << 16
#: Texts that a Python worker holds at a time, and their bytes (a longer text is held alone).
TEXTS_AT_ONCE, TEXT_BYTES_AT_ONCE = 1024, 1 << 21


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    The folder is the session's ``spark.checkpoint.dir``. Only a session on one machine
    may lack that setting and gets a folder of its own; a cluster without it is refused.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            shared = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def weigh(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and their bytes as text, which stand for their size in a broadcast."""
    found = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return found[0], found[1] or 0


def join_small(large: DataFrame, small: DataFrame, on: list[str], how: str, size: int, bound: int | None = None) -> DataFrame:
    """Join with a side of ``size`` known bytes: broadcast up to the bound, shuffled beyond it."""
    return large.join(F.broadcast(small) if size <= (BROADCAST_BYTES if bound is None else bound) else small, on, how)


def join_listed(large: DataFrame, listed: DataFrame, on: str, how: str, size: int, bound: int | None = None) -> DataFrame:
    """Semi or anti join of rows with a list of ``size`` known bytes that may grow with them; ``large`` is read twice beyond the bound.

    Up to ``LISTED_BYTES`` the list is broadcast. Beyond, a bitmap of hashed keys is, whose size
    does not grow: rows whose bit is not set are decided where they are, and only the others
    are shuffled and decided by the list itself.
    """
    if size <= (LISTED_BYTES if bound is None else bound):
        return large.join(F.broadcast(listed), on, how)
    place = F.pmod(F.xxhash64(on), F.lit(MARKS))
    bucket, bit = F.shiftright(place, 15).alias("__bucket"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("__bit")
    marks = listed.filter(F.col(on).isNotNull()).select(bucket, bit).groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__marks"))
    rows = large.select("*", F.when(F.col(on).isNotNull(), bucket).alias("__bucket"), bit)
    byte = F.conv(F.hex(F.substring("__marks", F.shiftright("__bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    rows = rows.join(F.broadcast(marks), "__bucket", "left")  # 1,024 rows of 4 KiB at most
    set_ = F.coalesce(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1, F.lit(False))
    rows = rows.withColumn("__set", set_).drop("__bucket", "__bit", "__marks")
    decided = rows.filter("__set").drop("__set").join(listed.hint("merge"), on, how)
    return decided if how == "left_semi" else decided.unionByName(rows.filter("not __set").drop("__set"))


def numbered_copies(df: DataFrame, n: str, name: str, most: int | None, *keys: str) -> DataFrame:
    """Each row as often as its column ``n`` (1 at least) says, numbered from 1 in ``name``.

    Copies are made in pieces of ``COPIES``. Where a row has more of them than that (``most``
    is the largest ``n``), its pieces are dealt to several tasks by ``keys`` and their number.
    """
    pieces = df.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES))))
    if most is not None and most > COPIES:
        # With a number, as adaptive execution would join such small pieces again.
        pieces = pieces.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "__piece")
    first = F.col("__piece") * COPIES + 1
    return pieces.withColumn(name, F.explode(F.sequence(first, F.least(F.col(n).cast("long"), first + (COPIES - 1))))).drop("__piece")


def slices(batch, column: int) -> Iterator:
    """``batch`` in parts of so few texts (those of ``column``) as a worker holds at a time."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and (i - first == TEXTS_AT_ONCE or held + size > TEXT_BYTES_AT_ONCE):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)


def per_text(docs: DataFrame, schema: str, make: Callable[[], Callable[[list], list[tuple]]], *beside: str) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id`` and the columns ``beside``, then what is found in its text.

    ``make()`` runs once in a worker and gives a function from texts (or nulls) to rows of
    ``schema``. All other columns pass through as they are, so that ids of any size stay
    exact beside nulls.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.select("doc_id", *beside)
    found = StructType.fromDDL(schema)
    whole = StructType([*kept.schema.fields, *found.fields])
    types = to_arrow_schema(whole)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        find = make()
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                rows = find(part.column(part.num_columns - 1).to_pylist())
                columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), [*types][part.num_columns - 1 :], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], schema=types)

    return docs.select("doc_id", *beside, F.col("text").cast("string").alias("__text")).mapInArrow(run, whole)


def n_words(text: Column) -> Column:
    """Number of words, without making an array of them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add (names compare as Spark compares them)."""
    taken = {x.lower() for x in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of whole rows, by which equal rows are told from others; maps go in as JSON."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return [F.xxhash64(F.lit(seed), *[x for p in plain for x in (p, p.isNull())]) for seed in (1, 2)]


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker does."""
    import sys
    import types

    return sys.modules.setdefault("_orrery_worker_cache", types.ModuleType("_orrery_worker_cache")).__dict__


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

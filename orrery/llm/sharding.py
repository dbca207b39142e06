"""Two-pass external shuffle into shards, by DataFrame functions only.

Pass one scatters the records over memory-sized buckets by a seeded hash. Pass two
permutes each bucket by Fisher-Yates and deals it out: a record's global position is
its bucket's offset plus its place in the permuted bucket, the shard is that position
modulo the number of shards and the slot the quotient. Shards thus differ by one row
at most, and slots have no gaps, whatever the sizes of the records.

The draws of Fisher-Yates are hashes of (seed, bucket, step), so a bucket that is
computed again after an executor is lost comes out the same. A permutation is drawn for
the number of rows of a bucket and applied to their ranks, so no bucket's rows need to
be held at a time. Rows are scattered by all that they hold; where equal rows are so many
that they would crowd one bucket, they are counted first and scattered by number, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from orrery.llm.common import cut, n_bytes, numbered_copies, row_hashes, without

BUCKET_BYTES = 8 << 20
BUCKET_ROWS = 768
SEED = 20_011
_SUPER = 1024
#: A bucket of so many times the rows it should hold is crowded by equal rows.
CROWDED = 8


def fisher_yates(n: Column, *key: Column) -> Column:
    """A permutation of 0..n-1 as an array; the draw of step i is a hash of ``key`` and i."""

    def swap(order: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*key, i), i + 1).cast("int")
        moved = F.concat(
            F.slice(order, F.lit(1), j),
            F.slice(order, i + 1, F.lit(1)),
            F.slice(order, j + 2, i - j - 1),
            F.slice(order, j + 1, F.lit(1)),
            F.slice(order, i + 2, n - i - 1),
        )
        return F.when(i == j, order).otherwise(moved)

    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), swap)


def external_shuffle(
    df: DataFrame,
    shards: int,
    *,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """All rows and columns of ``df``, with ``shard`` (int) and ``slot`` (long).

    Rows are scattered and ordered within buckets by hashes of all columns, so groups of
    equal texts, null keys and ties spread out; equal rows are interchangeable. Columns may be
    of any type. A null text counts as empty. An empty table gives no rows. Columns already
    named ``shard`` or ``slot`` are replaced; others that begin with two underscores may clash
    with nothing, as rows travel as one struct.
    """
    df = without(df, "shard", "slot")
    fields = df.columns
    weighed = df.agg(F.count(F.lit(1)).alias("n"), F.sum(n_bytes(F.col(f"`{text}`")) + 8).alias("b")).first()
    buckets = max(1, -(-weighed["n"] // bucket_rows), -(-(weighed["b"] or 0) // bucket_bytes))

    def scattered(nth: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "__a", "__b", nth), F.lit(buckets))

    a, b = row_hashes(df)
    row = F.struct(*[F.col(f"`{c}`") for c in fields])
    held = df.select(a.alias("__a"), b.alias("__b"), F.lit(0).cast("long").alias("__nth"), row.alias("__row"))
    held = held.withColumn("__bucket", scattered(F.col("__nth")))
    counts = cut(held.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")))
    if (counts.agg(F.max("__n")).first()[0] or 0) > CROWDED * bucket_rows:
        one = held.groupBy("__a", "__b").agg(F.first("__row").alias("__row"), F.count(F.lit(1)).alias("__many"))
        most = one.agg(F.max("__many")).first()[0]
        held = numbered_copies(one, "__many", "__nth", most, "__a", "__b").drop("__many")
        held = held.withColumn("__bucket", scattered(F.col("__nth")))
        counts = cut(held.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")))

    # The second pass needs to know where each bucket begins: sums over sums, so that no
    # task sees all buckets.
    counts = counts.withColumn("__super", F.floor(F.col("__bucket") / _SUPER))
    before = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("__in", F.coalesce(F.sum("__n").over(before("__super").orderBy("__bucket")), F.lit(0)))
    outer = counts.groupBy("__super").agg(F.sum("__n").alias("__m"))
    outer = outer.select("__super", F.coalesce(F.sum("__m").over(before().orderBy("__super")), F.lit(0)).alias("__out"))
    order = fisher_yates(F.col("__n").cast("int"), F.lit(seed), F.col("__bucket"))
    orders = inner.join(outer, "__super").select("__bucket", (F.col("__in") + F.col("__out")).alias("__offset"), order.alias("__order"))

    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("__a", "__b", "__nth"))
    ranked = held.withColumn("__rank", rank)
    place = F.col("__offset") + F.element_at("__order", F.col("__rank"))
    dealt = ranked.join(orders.hint("merge"), "__bucket").select("__row", place.alias("__place"))
    return dealt.select(
        *[F.col("__row")[c].alias(c) for c in fields],
        F.pmod("__place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__place") / shards).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """Write the shuffled rows as one folder per shard, each file in slot order."""
    done = external_shuffle(df, shards, **options)
    done.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The digest of ``external_shuffle`` under the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    return external_shuffle(docs, shards).select(
        "doc_id",
        (n_bytes(F.col("text")) + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

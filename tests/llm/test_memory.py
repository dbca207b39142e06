"""What a Python worker holds does not grow with the texts that it has seen or that come in a batch."""

import tracemalloc

from pyspark.sql import functions as F

from orrery.llm import language, neardup
from orrery.llm.common import TEXT_BYTES_AT_ONCE, per_text


def test_texts_at_once_are_bounded_by_bytes(spark):
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, F.repeat(F.lit("x"), 100_000)).alias("text")).coalesce(1)
    docs = docs.unionByName(spark.createDataFrame([(500, "y" * (TEXT_BYTES_AT_ONCE + 1))], "doc_id long, text string"))

    def make():
        return lambda texts: [(sum(len(t or "") for t in texts), len(texts))] * len(texts)

    found = {r["doc_id"]: r for r in per_text(docs, "held long, n long", make).collect()}
    assert len(found) == 121
    assert max(r["held"] for k, r in found.items() if k < 500) <= TEXT_BYTES_AT_ONCE
    assert found[500]["n"] == 1


def test_language_filter_keeps_rows_of_all_slices(spark):
    rows = [(i, None if i % 7 == 0 else "123" if i % 7 == 1 else "some words of a text " * 2000, "en") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    kept = sorted(r[0] for r in language.keep_identified(spark, docs).select("doc_id").collect())
    assert kept == [i for i in range(140) if i % 7 > 1]


def test_shingles_remember_no_words():
    neardup.shingles("a first call for the imports")
    tracemalloc.start()
    for i in range(40):
        neardup.shingles(" ".join(f"w{i}x{j}" for j in range(2000)))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1 << 20

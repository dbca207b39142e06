from pyspark.sql import functions as F

from orrery.streaming import resume


def test_pending_upsert_latest_and_signature(spark):
    work = spark.range(5).withColumnRenamed("id", "k")
    done = spark.createDataFrame([(0, "ok"), (1, "failed"), (2, "ok")], "k long, status string")
    assert sorted(r.k for r in resume.pending(work, done, "k").collect()) == [1, 3, 4]
    new = spark.createDataFrame([(1, "ok"), (3, "ok")], "k long, status string")
    assert sorted(map(tuple, resume.upsert(done, new, ["k"]).collect())) == [(0, "ok"), (1, "ok"), (2, "ok"), (3, "ok")]
    log = done.withColumn("at", F.lit(1)).unionByName(new.withColumn("at", F.lit(2)))
    assert {r.k: r.status for r in resume.latest(log, ["k"], "at").collect()} == {0: "ok", 1: "ok", 2: "ok", 3: "ok"}
    s = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "x string, y int").select(resume.signature("y", "x").alias("s"))
    assert s.distinct().count() == 2


def test_stream_of_results_and_windows(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(i % 3, "ok", f"2024-01-01 00:0{i % 6}:00", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, status string, t string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    q = resume.stream_results(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"]).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
    w = resume.windowed_progress(stream, "ts", "k")
    q = w.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from progress").first()[0] == 12

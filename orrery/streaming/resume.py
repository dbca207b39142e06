"""Resumable work: what is left to do, and idempotent results, in batch and as a stream.

A result table is keyed; a later row for a key replaces an earlier one. Work counts as
done only where its latest result succeeded, so failures are tried again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(work: DataFrame, results: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys of ``work`` without a successful result."""
    keys = [key] if isinstance(key, str) else list(key)
    return work.join(results.filter("status = 'ok'").select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with rows replaced by ``new`` of the same key, and new keys added."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def signature(*columns: str):
    """A key of what produced a row: equal inputs make equal signatures."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def latest(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = F.struct(*[c for c in results.columns if c not in keys])
    last = results.groupBy(*keys).agg(F.max_by(rest, F.col(order)).alias("__r"))
    return last.select(*keys, "__r.*")


def stream_results(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]):
    """Append batches of results, each key once a batch; the query's own checkpoint makes reruns exact."""

    def write(batch: DataFrame, number: int) -> None:
        out = batch.dropDuplicates(list(keys)).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(lambda b, n: write(b.drop("batch"), n)).option("checkpointLocation", checkpoint)


def windowed_progress(stream: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and mean value per key and time window, closed once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared checkpoint folder."""
    import uuid

    from orrery.operators.folds import checkpointed

    checkpointed(spark.range(1))  # sets a folder where there is none
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def chunk_signatures(df: DataFrame, id_: str, content: str, size: int, command: str, width: int = 1 << 16) -> DataFrame:
    """``chunk, signature``: chunks of ``size`` rows in the order of a whole-numbered id, signed by command, ids and content.

    Rows are numbered in ranges of ids that many tasks share, so no task sees them all.
    """
    from orrery.operators.order import spread

    at = spread(df.select(id_, content), [], F.floor(F.col(id_) / width), [id_]).withColumn("chunk", F.floor((F.col("__to_n") - 1) / size).cast("long"))
    each = F.struct(F.col(id_).alias("i"), F.concat_ws(":", F.col(id_).cast("string"), content).alias("t"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["t"]), ",")
    return at.groupBy("chunk").agg(F.sha2(F.concat(F.lit(f"{command}|"), listed), 256).alias("signature"))


class Schedule:
    """Steps of a run, and every how many it reports and saves; each must divide the next."""

    def __init__(self, steps: int, report: int, checkpoint: int):
        if min(steps, report, checkpoint) < 1:
            raise ValueError("steps and intervals must be positive")
        if checkpoint % report or steps % checkpoint:
            raise ValueError("reports must divide checkpoints, and these the steps")
        self.steps, self.report, self.checkpoint = steps, report, checkpoint


def resume_points(progress: DataFrame, done: str, schedule: Schedule) -> DataFrame:
    """``progress`` with ``state, resume_at, steps_left, reports``: runs go on from their last whole checkpoint.

    A run that claims more steps than the schedule has is not to be resumed; null or negative
    progress restarts.
    """
    at = F.greatest(F.coalesce(F.col(done), F.lit(0)), F.lit(0))
    saved = (F.floor(at / schedule.checkpoint) * schedule.checkpoint).cast("int")
    state = F.when(at > schedule.steps, "beyond_schedule").when(at == schedule.steps, "complete").when(saved == 0, "restart").otherwise("resume")
    inside = at <= schedule.steps
    return progress.withColumns({
        "state": state,
        "resume_at": F.when(inside, saved),
        "steps_left": F.when(inside, F.lit(schedule.steps) - saved),
        "reports": F.when(inside, F.floor(at / schedule.report).cast("int")),
    })

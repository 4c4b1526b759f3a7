"""Streams with keyed state: dedupe, quota, timeouts.

A micro-batch goes through the batch operators, which split hot keys, and
starts from the state the batch before it left. State and output of batch ``n``
are Parquet folders of that number below ``root``; a batch that runs again
reads the state before its own and overwrites both, so every row is decided
once. The state of the last two batches is kept.

The writers need ``checkpointLocation`` and a trigger, and are started by the
caller; ``read_decided`` has what all finished batches decided.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from joblog.operators.dedupe import active_keys, dedupe_in_flight
from joblog.operators.outcomes import deadline_micros, match_results, orphan_results, timed_out
from joblog.operators.quota import GROUP, WINDOW_SECONDS, admit_quota
from joblog.operators.tasks import quota_bound
from joblog.plans.ordered import pick_per
from joblog.sources.versions import list_dirs, remove_dir

_BATCH = "batch="
# Step: (batch, state) to (output, function from the written output to the next state).
Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]]


def _numbered(spark: SparkSession, folder: str) -> list[int]:
    return [int(n.removeprefix(_BATCH)) for n in list_dirs(spark, folder, _BATCH)]


def _state_before(spark: SparkSession, root: str, batch_id: int | None, schema: str) -> DataFrame:
    earlier = [n for n in _numbered(spark, f"{root}/state") if batch_id is None or n < batch_id]
    if not earlier:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/state/{_BATCH}{earlier[-1]:012d}")


def _folded(stream: DataFrame, root: str, schema: str, step: Step) -> DataStreamWriter:
    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            out, after = step(batch, _state_before(spark, root, batch_id, schema))
            place = f"{root}/out/{_BATCH}{batch_id:012d}"
            out.write.mode("overwrite").parquet(place)
            written = spark.read.schema(out.schema).parquet(place)
            after(written).write.mode("overwrite").parquet(f"{root}/state/{_BATCH}{batch_id:012d}")
        finally:
            batch.unpersist()
        for number in _numbered(spark, f"{root}/state")[:-2]:
            remove_dir(spark, f"{root}/state/{_BATCH}{number:012d}")

    return stream.writeStream.foreachBatch(one)


def read_decided(spark: SparkSession, root: str) -> DataFrame:
    """The output of all finished batches."""
    paths = [f"{root}/out/{_BATCH}{n:012d}" for n in _numbered(spark, f"{root}/out")]
    if not paths:
        raise ValueError(f"no finished batch in {root}")
    return spark.read.parquet(*paths)


def stream_dedupe(events: DataFrame, root: str) -> DataStreamWriter:
    """``dedupe_in_flight`` on a stream of (seq, payload_key, kind): in arrival order, by ``seq`` inside a batch."""

    def step(batch: DataFrame, active: DataFrame):
        def after(_: DataFrame) -> DataFrame:
            touched = batch.select("payload_key").distinct()
            return active_keys(batch).unionByName(active.join(touched, "payload_key", "left_anti"))

        return dedupe_in_flight(batch, active), after

    return _folded(events, root, "payload_key string", step)


def stream_quota(requests: DataFrame, root: str, window: int = WINDOW_SECONDS) -> DataStreamWriter:
    """``admit_quota`` (anchored) on a stream: in arrival order, by (ts, seq) inside a batch.

    A request older than its group's window counts in that window, as it would
    on arrival; it cannot reopen what is past.
    """

    def step(batch: DataFrame, windows: DataFrame):
        begun = windows.select(GROUP, F.col("window_start").alias("__begun"))
        standing = batch.join(begun, GROUP, "left").withColumn("__arrived", F.col("ts"))
        standing = standing.withColumn("ts", F.greatest("ts", "__begun")).drop("__begun")
        told = admit_quota(standing, window, windows=windows)
        out = told.withColumn("ts", F.col("__arrived")).select(*batch.columns, "admitted", "window_start", "window_count")

        def after(written: DataFrame) -> DataFrame:
            # Counts only grow inside a window, and windows only follow each other.
            last = quota_bound(written).groupBy(GROUP).agg(F.max(F.struct("window_start", "window_count")).alias("__last"))
            moved = last.select(GROUP, F.col("__last.window_count").alias("count"), F.col("__last.window_start").alias("window_start"))
            return moved.unionByName(windows.join(moved, GROUP, "left_anti"))

        return out, after

    return _folded(requests, root, f"{GROUP} string, count int, window_start timestamp", step)


_EVENT = "role string, task_id string, ts timestamp, id bigint, max_execution_seconds bigint, webhook_url string, status string, error_msg string"
_OUTCOME = ("kind", "task_id", "exec_id", "result_id", "status", "error")


def _events(executions: DataFrame, results: DataFrame) -> DataFrame:
    url = F.col("webhook_url") if "webhook_url" in executions.columns else F.lit(None).cast("string")
    none = F.lit(None)
    starts = executions.select(
        F.lit("execution").alias("role"), "task_id", F.col("exec_ts").alias("ts"), F.col("exec_id").cast("bigint").alias("id"),
        F.col("max_execution_seconds").cast("bigint").alias("max_execution_seconds"), url.alias("webhook_url"),
        none.cast("string").alias("status"), none.cast("string").alias("error_msg"),
    )
    ends = results.select(
        F.lit("result").alias("role"), "task_id", F.col("result_ts").alias("ts"), F.col("result_id").cast("bigint").alias("id"),
        none.cast("bigint").alias("max_execution_seconds"), none.cast("string").alias("webhook_url"), "status", "error_msg",
    )
    return starts.unionByName(ends)


def _split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    starts = events.filter("role = 'execution'").select("task_id", F.col("ts").alias("exec_ts"), F.col("id").alias("exec_id"), "max_execution_seconds", "webhook_url")
    ends = events.filter("role = 'result'").select("task_id", F.col("ts").alias("result_ts"), F.col("id").alias("result_id"), "status", "error_msg")
    return starts, ends


def _decided(ready: DataFrame, cutoff) -> DataFrame:
    """Matched results, orphans, and limits that have passed by ``cutoff``."""
    starts, ends = _split(ready)
    failed = F.when(F.col("status") != "success", F.coalesce("error_msg", F.lit("Unknown error")))
    none = F.lit(None)
    matched = match_results(starts, ends).select(F.lit("matched").alias("kind"), "task_id", "exec_id", "result_id", "status", failed.alias("error"))
    orphans = orphan_results(starts, ends).select(
        F.lit("orphan").alias("kind"), "task_id", none.cast("bigint").alias("exec_id"), "result_id", "status", F.col("message").alias("error")
    )
    late = timed_out(starts, ends, as_of=cutoff).select(
        F.lit("timeout").alias("kind"), "task_id", "exec_id", none.cast("bigint").alias("result_id"), none.cast("string").alias("status"), "error"
    )
    return matched.unionByName(orphans).unionByName(late).select(*_OUTCOME)


def _open_after(ready: DataFrame, cutoff) -> DataFrame:
    """Executions that later rows may still concern: the pending one of each task, and those whose limit still runs."""
    starts, ends = _split(ready)
    last = pick_per(ready, ["task_id"], ["ts", "role", "id"]).filter("role = 'execution'")
    passed = F.coalesce(deadline_micros(last.withColumnRenamed("ts", "exec_ts")) < F.unix_micros(cutoff), F.lit(False))
    pending = last.withColumnRenamed("ts", "exec_ts").filter(~passed).select("id")
    running = timed_out(starts, ends).filter(F.col("deadline") >= cutoff).select(F.col("exec_id").alias("id"))
    keep = pending.unionByName(running).distinct()
    return ready.filter("role = 'execution'").join(keep, "id", "left_semi").select(*ready.columns)


def stream_timeouts(executions: DataFrame, results: DataFrame, root: str, delay_seconds: int = 0) -> DataStreamWriter:
    """Executions and results as they come: rows of ``kind`` matched, orphan or timeout.

    Rows wait until an event ``delay_seconds`` later has been seen, so inputs out
    of order by up to that are decided as ``match_results``, ``orphan_results``
    and ``timed_out`` decide them. Rows that come later still are decided when
    they come: such a result is an orphan unless its execution is still open.
    Every result is in exactly one output.
    """

    def step(batch: DataFrame, state: DataFrame):
        newest = F.max("ts")
        pool = state.filter("role in ('held_execution', 'held_result')").withColumn("role", F.regexp_replace("role", "held_", "")).unionByName(batch)
        clock = state.filter("role = 'clock'").select("ts").unionByName(batch.select("ts")).agg(newest).first()[0]
        cutoff = F.timestamp_micros(F.unix_micros(F.lit(clock).cast("timestamp")) - delay_seconds * 1_000_000)
        opened = state.filter("role = 'execution'")
        ready = opened.unionByName(pool.filter(F.col("ts") <= cutoff))

        def after(_: DataFrame) -> DataFrame:
            held = pool.filter(F.col("ts") > cutoff).withColumn("role", F.concat(F.lit("held_"), "role"))
            tick = batch.sparkSession.range(1).select(F.lit("clock").alias("role"), F.lit(clock).cast("timestamp").alias("ts"))
            return _open_after(ready, cutoff).unionByName(held).unionByName(tick, allowMissingColumns=True)

        return _decided(ready, cutoff), after

    return _folded(_events(executions, results), root, _EVENT, step)


def held_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """What the rows that still wait decide as of the last event seen; for the end of a stream."""
    state = _state_before(spark, root, None, _EVENT)
    clock = state.filter("role = 'clock'").agg(F.max("ts")).first()[0]
    rows = state.filter("role <> 'clock'").withColumn("role", F.regexp_replace("role", "held_", ""))
    return _decided(rows, F.lit(clock).cast("timestamp"))


def stream_orphans(tracked: DataFrame) -> DataFrame:
    """The results that found no pending execution, from the output of ``stream_timeouts``."""
    return tracked.filter(F.col("kind") == "orphan").select(
        "result_id", "task_id", "status", F.col("error").alias("message")
    )

"""Streaming operators run over the whole fixture views (registered on import).

Each view arrives in a few pieces, in order; see ``Replay``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from joblog import streaming
from joblog.fixtures import QUOTA_WINDOW, TASK_AS_OF
from joblog.operators import state, tasks
from joblog.queries import LOG_COLUMNS, TASK_KEYS, Views, _saved_windows, query
from joblog.session import scratch_path
from joblog.sources import messages

PIECES = 4
DELAY = 4 * 24 * 3600


class Replay:
    """A view as a stream that arrives in ``PIECES`` pieces, in the given order.

    A piece is as many files as Spark writes for it. A run up to the end of what
    is there takes a piece as one micro-batch; the next run resumes from the
    checkpoint with the next piece.
    """

    def __init__(self, df: DataFrame, order: str, fmt: str = "parquet"):
        # A session of its own: state is kept per shuffle partition and settings stay local to it.
        self.spark = df.sparkSession.newSession()
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.spark.sparkContext.defaultParallelism))
        self.df, self.order, self.fmt = df, order, fmt
        self.path = scratch_path(df.sparkSession, "replay")
        self.low, high = df.agg(F.min(order), F.max(order)).first()
        self.step = (high - self.low) / PIECES
        self._add(0)
        stream = self.spark.readStream
        self.stream = stream.text(self.path) if fmt == "text" else stream.schema(df.schema).parquet(self.path)

    def _add(self, piece: int) -> None:
        part = self.df.filter(F.col(self.order) >= self.low + self.step * piece)
        if piece < PIECES - 1:
            part = part.filter(F.col(self.order) < self.low + self.step * (piece + 1))
        if self.fmt == "text":
            part.select("value").write.mode("append").text(self.path)
        else:
            part.write.mode("append").parquet(self.path)

    def decided(self, make) -> str:
        """The folder in which the writer ``make(root)`` keeps what it decides over the pieces."""
        root = scratch_path(self.df.sparkSession, "decided")
        self.run(make(root))
        return root

    def run(self, writer: DataStreamWriter, last: Callable[[], None] | None = None) -> None:
        """All pieces in turn; then, if given, what ``last`` adds."""
        writer = writer.option("checkpointLocation", scratch_path(self.df.sparkSession, "stream"))
        for piece in range(PIECES):
            if piece:
                self._add(piece)
            writer.trigger(availableNow=True).start().awaitTermination()
        if last:
            last()
            writer.trigger(availableNow=True).start().awaitTermination()

    def appended(self, stream: DataFrame, last: Callable[[], None] | None = None) -> DataFrame:
        """All rows that ``stream`` appends over the pieces."""
        out = scratch_path(self.df.sparkSession, "out")
        self.run(stream.writeStream.format("parquet").option("path", out), last)
        return self.df.sparkSession.read.parquet(out)


@query
def stream_messages(v: Views) -> DataFrame:
    replay = Replay(v.messages, "seq", "text")
    return replay.appended(streaming.stream_messages(replay.spark, replay.path)).select(
        "action", "task_id", "task_type", "task_data", "data", "status", "error"
    )


@query
def stream_due(v: Views) -> DataFrame:
    """One tick of the stream, of a clock that stands at a fixed time."""
    hand, out = scratch_path(v.spark, "clock"), scratch_path(v.spark, "ticked")
    now = v.spark.range(1).select(tasks.instant(TASK_AS_OF).alias("timestamp"))
    now.write.parquet(hand)

    def keep(decided: DataFrame, as_of: object, batch_id: int) -> None:
        decided.select(*TASK_KEYS, "admitted").write.mode("overwrite").parquet(f"{out}/{batch_id}")

    clock = v.spark.readStream.schema(now.schema).parquet(hand)
    writer = streaming.stream_due(
        v.spark, lambda: v.tasks, lambda: _saved_windows(v), keep, scratch_path(v.spark, "stream"), v.in_flight, clock=clock
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{out}/0")


@query
def stream_latest(v: Views) -> DataFrame:
    root = scratch_path(v.spark, "latest")
    replay = Replay(v.task_log, "seq")
    replay.run(streaming.stream_latest(replay.stream, root))
    return streaming.read_latest(v.spark, root).select("seq", *LOG_COLUMNS)


@query
def stream_dedupe(v: Views) -> DataFrame:
    replay = Replay(v.payload_events, "seq")
    return replay.appended(streaming.keyed_dedupe(replay.stream))


@query
def stream_quota(v: Views) -> DataFrame:
    replay = Replay(v.requests, "seq")
    return replay.appended(streaming.keyed_quota(replay.stream, QUOTA_WINDOW))


def _tracked(v: Views) -> DataFrame:
    starts = v.executions.withColumn("__result", F.lit(False))
    events = starts.withColumnsRenamed({"exec_id": "id", "exec_ts": "ts"}).unionByName(
        v.results.withColumnsRenamed({"result_id": "id", "result_ts": "ts"}).withColumn("__result", F.lit(True)),
        allowMissingColumns=True,
    )
    # Rows arrive up to DELAY late, so the pieces overlap in time.
    late = F.pmod(F.col("id") * 7919, F.lit(97)) * (DELAY // 97) * 1_000_000
    replay = Replay(events.withColumn("arrival", F.unix_micros("ts") + late), "arrival")
    executions = replay.stream.filter("not __result").withColumnsRenamed({"id": "exec_id", "ts": "exec_ts"})
    results = replay.stream.filter("__result").withColumnsRenamed({"id": "result_id", "ts": "result_ts"})
    hand = scratch_path(v.spark, "clock")
    end = events.agg(F.max("ts")).first()[0]

    def tick(at) -> None:
        v.spark.range(1).select(F.lit(at).cast("timestamp").alias("timestamp")).write.mode("append").parquet(hand)

    tick(events.agg(F.min("ts")).first()[0])
    clock = replay.spark.readStream.schema("timestamp timestamp").parquet(hand)
    # No event comes after the last piece: what still waits is decided by the clock alone.
    return replay.appended(streaming.keyed_timeouts(executions, results, DELAY, clock), lambda: tick(end + dt.timedelta(seconds=DELAY, milliseconds=1)))


@query
def stream_timeouts(v: Views) -> DataFrame:
    return _tracked(v)


@query
def stream_orphans(v: Views) -> DataFrame:
    return streaming.stream_orphans(_tracked(v))


@query
def stream_progress(v: Views) -> DataFrame:
    replay = Replay(v.messages, "seq")
    return replay.appended(streaming.stream_progress(messages.decode_messages(replay.stream)))


@query
def stream_stats(v: Views) -> DataFrame:
    """The counters after the last micro-batch."""
    out = scratch_path(v.spark, "stats")
    replay = Replay(v.messages, "seq")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    counters = streaming.stream_stats(messages.decode_messages(replay.stream))
    replay.run(counters.writeStream.outputMode("complete").foreachBatch(keep))
    return v.spark.read.parquet(out).orderBy(F.desc("batch")).limit(1).drop("batch", "part")

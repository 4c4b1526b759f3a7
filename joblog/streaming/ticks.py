"""The dispatch tick on a clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from joblog.operators.quota import admit_due
from joblog.operators.tasks import due_tasks, instant

# Fixed value: time between ticks.
TICK = "2 seconds"


def due_batch(state: DataFrame, windows: DataFrame, as_of, in_flight: DataFrame | None = None) -> DataFrame:
    """What one tick decides: due rows with ``admitted``, most urgent first within each quota."""
    return admit_due(due_tasks(state, as_of, in_flight), windows, as_of)


def stream_due(
    spark: SparkSession,
    load_state: Callable[[], DataFrame],
    load_windows: Callable[[], DataFrame],
    on_tick: Callable[[DataFrame, object, int], None],
    checkpoint: str,
    load_in_flight: Callable[[], DataFrame] | None = None,
    interval: str = TICK,
    clock: DataFrame | None = None,
) -> DataStreamWriter:
    """Writer that evaluates the tick again and again, delayed and deferred rows included.

    A ``rate`` source is the clock: a file stream fires no batch without new
    files, so rows would not come due. ``on_tick`` gets the decided rows, the
    tick's time and its batch number, by which it should make its writes
    idempotent. Another ``clock`` is a stream with a ``timestamp``; its triggers
    are the caller's.
    """

    def tick(clock: DataFrame, batch_id: int) -> None:
        now = clock.agg(F.unix_micros(F.max("timestamp"))).first()[0]
        if now is None:
            return
        as_of = F.timestamp_micros(F.lit(now))
        in_flight = load_in_flight() if load_in_flight else None
        on_tick(due_batch(load_state(), load_windows(), instant(as_of), in_flight), now, batch_id)

    if clock is not None:
        return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).trigger(processingTime=interval).option(
        "checkpointLocation", checkpoint
    )

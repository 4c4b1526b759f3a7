"""Duplicate payloads, dropped while an equal one is still in flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.plans.ordered import HOT_ROWS, SEQ_CHUNK, pick_per, previous_row, seq_chunk

ENQUEUE = "enqueue"


# Comes before every event: where a key that is active from the start stands.
BEFORE = -(1 << 62)


def dedupe_in_flight(
    events: DataFrame, active: DataFrame | None = None, chunk_rows: int = SEQ_CHUNK, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``accepted`` to the enqueue rows of (seq, payload_key, kind) events.

    A key is active from an accepted enqueue to its release (any other kind), so
    an enqueue is accepted when the event before it on its key is a release, or
    when there is none. Keys in the first column of ``active`` are active from
    the start. Rows without a key are always accepted and skip the shuffle.
    """
    keyed = events.filter(F.col("payload_key").isNotNull()).withColumn("__enqueue", F.col("kind") == ENQUEUE)
    if active is not None:
        first = active.select(F.col(active.columns[0]).alias("payload_key"), F.lit(BEFORE).alias("seq"), F.lit(True).alias("__enqueue"))
        keyed = keyed.unionByName(first.filter("payload_key is not null").distinct(), allowMissingColumns=True)
    ordered = previous_row(
        keyed, ["payload_key"], ["seq"], seq_chunk("seq", chunk_rows), ["__enqueue"], "__before", hot_rows
    )
    accepted = (
        ordered.filter(F.col("__enqueue") & (F.col("seq") > BEFORE))
        .withColumn("accepted", ~F.coalesce(F.col("__before__enqueue"), F.lit(False)))
        .drop("__enqueue", "__before__enqueue")
    )
    free = events.filter(F.col("payload_key").isNull() & (F.col("kind") == ENQUEUE))
    return accepted.unionByName(free.withColumn("accepted", F.lit(True)))


def active_keys(events: DataFrame) -> DataFrame:
    """Keys still active after (seq, payload_key, kind) events: those whose last event is an enqueue."""
    keyed = events.filter(F.col("payload_key").isNotNull())
    return pick_per(keyed, ["payload_key"], ["seq"]).filter(F.col("kind") == ENQUEUE).select("payload_key")


def drop_active_payloads(df: DataFrame, active: DataFrame, key: str = "payload_hash") -> DataFrame:
    """Arrivals whose payload key is not active; rows without a key pass.

    A row without a key joins on its task id, marked so that it cannot meet a
    key; such rows spread over the tasks instead of meeting in one. A hot key on
    the arriving side is split by the adaptive skew join, which may split the
    left side of an anti join.
    """
    keys = active.select(F.lit(False).alias("__free"), F.col(active.columns[0]).alias("__key"))
    marked = df.withColumns({"__free": F.col(key).isNull(), "__key": F.coalesce(F.col(key), F.col("task_id"))})
    return marked.join(keys, ["__free", "__key"], "left_anti").drop("__free", "__key")

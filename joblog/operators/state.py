"""Task state from a change log, and changes to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.operators.tasks import live_tasks, tombstone
from joblog.plans.ordered import pick_per

# A log is due for compaction beyond any of these.
COMPACT_BYTES = 20 * 1024 * 1024
COMPACT_TOMBSTONE_RATIO = 0.5
COMPACT_APPENDS = 10_000


def latest_versions(log: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Last version of each id by ``seq``, tombstones included."""
    return pick_per(log, keys, ["seq"])


def latest_tasks(log: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Live state: the last version of each id, then without tombstones.

    The tombstone filter has to stay above the pick: an id may be written again
    after its tombstone, and an older live version must not come back.
    """
    return live_tasks(latest_versions(log, keys))


def compact_task_log(log: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """The rows a compacted log keeps: live, latest, one per id."""
    return latest_tasks(log, keys)


def log_health(log: DataFrame) -> DataFrame:
    """Size counters of a log and whether it is due for compaction.

    ``bytes`` is known for logs read from files (columns ``file_path`` and
    ``file_size``); rows are first counted per file, so each size counts once.
    """
    counts = [
        F.count_if(F.col("deleted_at").isNull()).alias("live_lines"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("tombstone_lines"),
        F.count(F.lit(1)).alias("appends"),
    ]
    if "file_size" in log.columns:
        per_file = log.groupBy("file_path").agg(*counts, F.max("file_size").alias("bytes"))
    else:
        per_file = log.agg(*counts).withColumn("bytes", F.lit(None).cast("bigint"))
    total = per_file.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("live_lines", "tombstone_lines", "appends")],
        F.sum("bytes").alias("bytes"),
    )
    ratio = F.when(F.col("live_lines") > 0, F.col("tombstone_lines").cast("double") / F.col("live_lines"))
    return total.withColumn("tombstone_ratio", ratio).withColumn(
        "should_compact",
        (F.coalesce(F.col("bytes"), F.lit(0)) > COMPACT_BYTES)
        | (F.coalesce(F.col("tombstone_ratio"), F.lit(0.0)) > COMPACT_TOMBSTONE_RATIO)
        | (F.col("appends") >= COMPACT_APPENDS),
    )


def queue_depth(state: DataFrame) -> DataFrame:
    return live_tasks(state).agg(F.count(F.lit(1)).alias("queue_depth"))


def active_payload_keys(state: DataFrame) -> DataFrame:
    """Distinct payload keys of live rows."""
    return live_tasks(state).filter(F.col("payload_hash").isNotNull()).select("payload_hash").distinct()


def delete_tasks(state: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Tombstone versions for the ids that are live; other ids do nothing."""
    return tombstone(live_tasks(state).join(ids.select("task_id"), "task_id", "left_semi"), as_of)


def upsert_tasks(state: DataFrame, changes: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """State after ``changes``: insert or overwrite by id, a tombstone removes.

    Both sides carry ``seq``; changes must be later than the state they change.
    """
    return latest_tasks(state.unionByName(changes, allowMissingColumns=True), keys)

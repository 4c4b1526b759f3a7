"""Live task state kept current from a stream of task versions.

A micro-batch writes the latest versions it brought as a delta of its own, so
the cost of a batch follows the batch and not the state. Reading merges the
current base with the deltas after it; compaction writes the merge as the next
base.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from joblog.operators.state import latest_tasks, latest_versions
from joblog.sources.versions import list_dirs, modified_at, remove_dir

_BASE, _DELTA = "upto=", "batch="


def stream_latest(log: DataFrame, root: str) -> DataStreamWriter:
    """Writer that keeps ``root`` current; a replayed batch replaces its own delta.

    The caller sets ``checkpointLocation`` and trigger, and starts it.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        latest_versions(batch).write.mode("overwrite").parquet(f"{root}/{_DELTA}{batch_id:012d}")

    return log.writeStream.foreachBatch(merge)


def _parts(spark: SparkSession, root: str) -> tuple[list[str], int]:
    """Paths to merge, and the number of the last batch among them."""
    bases = list_dirs(spark, root, _BASE)
    upto = int(bases[-1].removeprefix(_BASE)) if bases else -1
    deltas = [n for n in list_dirs(spark, root, _DELTA) if int(n.removeprefix(_DELTA)) > upto]
    last = int(deltas[-1].removeprefix(_DELTA)) if deltas else upto
    return [f"{root}/{n}" for n in bases[-1:] + deltas], last


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """Live tasks as of the last finished batch."""
    paths, _ = _parts(spark, root)
    if not paths:
        raise ValueError(f"no finished batch in {root}")
    return latest_tasks(spark.read.parquet(*paths))


def compact_latest(spark: SparkSession, root: str) -> str:
    """Merge base and deltas into the next base; returns its path.

    Tombstones end here, so log order has to be arrival order across batches.
    """
    _, last = _parts(spark, root)
    path = f"{root}/{_BASE}{last:012d}"
    if path.rsplit("/", 1)[1] not in list_dirs(spark, root, _BASE):
        # A folder without its marker is what a crash left; it does not count and is replaced.
        read_latest(spark, root).write.mode("overwrite").parquet(path)
    return path


def remove_merged(spark: SparkSession, root: str, before: dt.datetime) -> int:
    """Remove deltas and bases that a base finished before ``before`` (UTC) has merged; returns how many.

    Readers list once and then read, so ``before`` should lie back by the
    longest read. This bounds what a reader lists.
    """
    bases = list_dirs(spark, root, _BASE)
    limit = before.replace(tzinfo=before.tzinfo or dt.timezone.utc).timestamp() * 1000
    settled = [b for b in bases if modified_at(spark, f"{root}/{b}") < limit]
    if not settled:
        return 0
    upto = int(settled[-1].removeprefix(_BASE))
    old = settled[:-1] + [n for n in list_dirs(spark, root, _DELTA) if int(n.removeprefix(_DELTA)) <= upto]
    for name in old:
        remove_dir(spark, f"{root}/{name}")
    return len(old)

"""Streams with Spark's own keyed state: dedupe, quota, and execution tracking with timers.

Each function returns a streaming DataFrame to be written in append mode. What a
key has to remember lies in the state store, so the work of a micro-batch follows
its rows and the timers that run out, not the number of keys. The store is
RocksDB with a changelog, set on the stream's session.

A batch's rows of one key (of one bucket, where tasks are tracked) meet in one task, in memory; bound the batch by
``maxFilesPerTrigger``. Integers and instants of other columns are carried
through pandas as text, so that nulls beside them cannot change them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from joblog.operators.dedupe import ENQUEUE
from joblog.operators.outcomes import deadline_micros
from joblog.operators.quota import GROUP, LIMIT, WINDOW_SECONDS
from joblog.operators.tasks import quota_bound

# Fixed value: the state store whose cost follows what changes.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_session(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _as_text(df: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    def text(field: T.StructField):
        column = F.col(field.name)
        if field.name in skip:
            return column
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_micros(column).cast("string").alias(field.name)
        return column.cast("string").alias(field.name) if isinstance(field.dataType, T.IntegralType) else column

    return df.select(*[text(f) for f in df.schema.fields])


def _from_text(df: DataFrame, schema: T.StructType, skip: tuple[str, ...]) -> DataFrame:
    def back(field: T.StructField):
        column = F.col(field.name)
        if field.name in skip:
            return column
        if isinstance(field.dataType, T.TimestampType):
            return F.timestamp_micros(column.cast("bigint")).alias(field.name)
        return column.cast(field.dataType).alias(field.name)

    own = {f.name for f in schema.fields}
    return df.select(*[back(f) for f in schema.fields], *[c for c in df.columns if c not in own])


def _run(rows: DataFrame, key: str, step: Callable, extra: str, state: str) -> DataFrame:
    keyed_session(rows.sparkSession)
    shape = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(extra).fields])
    return rows.groupBy(key).applyInPandasWithState(step, shape, state, "append", GroupStateTimeout.NoTimeout)


def _gathered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(rows)
    return parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)


def _dedupe(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    events = _gathered(rows)
    if len(events) > 1:
        events = events.iloc[np.argsort(events["seq"].to_numpy(), kind="stable")]
    enqueue = (events["kind"] == ENQUEUE).to_numpy()
    was = state.exists
    accepted = np.concatenate(([not was], ~enqueue[:-1]))
    if enqueue[-1] and not was:
        state.update((True,))
    elif was and not enqueue[-1]:
        state.remove()
    if enqueue.any():
        events = events if enqueue.all() else events[enqueue]
        yield events.assign(accepted=accepted[enqueue])


def keyed_dedupe(events: DataFrame) -> DataFrame:
    """``dedupe_in_flight`` of a stream (seq, payload_key, kind): in arrival order, by ``seq`` inside a batch.

    An active key is one flag; a released one leaves nothing behind.
    """
    skip = ("seq",)
    slim = _as_text(events.filter("payload_key is not null"), skip)
    told = _from_text(_run(slim, "payload_key", _dedupe, "accepted boolean", "active boolean"), events.schema, skip)
    free = events.filter((F.col("payload_key").isNull()) & (F.col("kind") == ENQUEUE)).withColumn("accepted", F.lit(True))
    return told.unionByName(free)


def _quota(width: int) -> Callable:
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (None, 0)
        requests = _gathered(rows)
        at = requests["turn_micros"].to_numpy()
        # What is older than the window that stands counts in it.
        at = at if start is None else np.maximum(at, start)
        order = np.lexsort((requests["seq"].to_numpy(), at))
        admitted, starts, counts = [], [], []
        for ts, limit in zip(at[order].tolist(), requests["turn_limit"].to_numpy()[order].tolist(), strict=True):
            if start is None or ts - start >= width:
                start, count = ts, 0
            allow = count < limit
            count += allow
            admitted.append(allow)
            starts.append(start)
            counts.append(count)
        state.update((start, count))
        yield requests.iloc[order].assign(admitted=admitted, turn_start=starts, window_count=counts)

    return step


def keyed_quota(requests: DataFrame, window: int = WINDOW_SECONDS) -> DataFrame:
    """``admit_quota`` (anchored) of a stream: in arrival order, by (ts, seq) inside a batch.

    A group's state is its window's start and count. A request older than that
    window counts in it. Rows without a group or a limit are not limited.
    """
    skip = ("seq", "turn_micros", "turn_limit")
    bound = quota_bound(requests).withColumns({"turn_micros": F.unix_micros("ts"), "turn_limit": F.col(LIMIT).cast("bigint")})
    told = _run(_as_text(bound, skip), GROUP, _quota(window * 1_000_000), "admitted boolean, turn_start bigint, window_count int", "start bigint, count bigint")
    added = ("admitted", "window_start", "window_count")
    told = _from_text(told, requests.schema, skip).withColumn("window_start", F.timestamp_micros("turn_start"))
    none = {"admitted": F.lit(True), "window_start": F.lit(None).cast("timestamp"), "window_count": F.lit(None).cast("int")}
    free = requests.filter(F.col(GROUP).isNull() | F.col(LIMIT).isNull()).withColumns(none)
    return told.select(*requests.columns, *added).unionByName(free.select(*requests.columns, *added))


_EXECUTION, _RESULT = 0, 1
_NO_LIMIT = (1 << 63) - 1
_EVENT = "role int, ts bigint, id bigint, deadline bigint, status string, error_msg string"
_OUTCOME = "kind string, task_id string, exec_id bigint, result_id bigint, status string, error string"
_PARTS = tuple(part.split()[0] for part in _EVENT.split(", "))
_NAMES = tuple(part.split()[0] for part in _OUTCOME.split(", "))
_HELD = ("task_id", *_PARTS)
_TEXTS = ("task_id", "status", "error_msg", "kind", "error")
# Stands for null among ids.
_NO_ID = -(1 << 63)
# Tasks share their state in so many buckets: a call of the state's function serves all tasks of one.
BUCKETS = 256
# Within what pandas can hold.
_FAR = "2261-01-01 00:00:00"


def _columns(rows: list[tuple], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    parts = list(zip(*rows, strict=True)) or [()] * len(names)
    return {n: np.array(p, object if n in _TEXTS else np.int64) for n, p in zip(names, parts, strict=True)}


def _taken(events: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {n: c[which] for n, c in events.items()}


def _together(*parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([p[n] for p in parts]) for n in _HELD}


def settled(events: dict[str, np.ndarray], cutoff: int) -> tuple[list[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """What the events of many tasks up to ``cutoff`` (micros) decide, and the executions that later events may still concern.

    What has no limit has a deadline that never comes. A result takes the
    execution right before it if that one's limit still runs; else it is an
    orphan. A limit passes if no result of the task came within it.
    """
    code = pd.factorize(events["task_id"])[0]
    order = np.lexsort((events["id"], events["role"], events["ts"], code))
    code, rows = code[order], _taken(events, order)
    n, ts, role, deadline = len(code), rows["ts"], rows["role"], rows["deadline"]
    same = code[1:] == code[:-1]
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:], last[:-1] = ~same, ~same
    result = role == _RESULT
    before = np.maximum(np.arange(n) - 1, 0)
    matched = result & ~first & (role[before] == _EXECUTION) & (ts <= deadline[before])
    # The next result of all, and whether it is of the same task.
    after = np.minimum.accumulate(np.where(result, np.arange(n), n)[::-1])[::-1]
    at = np.minimum(after, n - 1)
    in_time = (after < n) & (code[at] == code) & (ts[at] <= deadline)
    limited = deadline < _NO_LIMIT
    open_ = ~result & limited & ~in_time
    passed = open_ & (deadline < cutoff)
    kept = ~passed & (open_ | (~result & last & ~limited))
    none = np.full(n, _NO_ID)
    nothing = np.full(n, None, object)

    def outcome(kind: str, which: np.ndarray, exec_id: np.ndarray, result_id: np.ndarray, status: np.ndarray, error: list) -> dict[str, np.ndarray]:
        told = _columns([], _NAMES) | {"kind": np.full(int(which.sum()), kind, object), "task_id": rows["task_id"][which]}
        return told | {"exec_id": exec_id[which], "result_id": result_id[which], "status": status[which], "error": np.array(error, object)}

    failed = [None if s == "success" else "Unknown error" if e is None else e for s, e in zip(rows["status"][matched], rows["error_msg"][matched], strict=True)]
    orphan = result & ~matched
    unknown = [None if t is None else f"Received result for unknown/expired task_id {t}" for t in rows["task_id"][orphan]]
    late = [f"Task execution timed out after {x} seconds" for x in ((deadline[passed] - ts[passed]) // 1_000_000).tolist()]
    out = [
        outcome("matched", matched, rows["id"][before], rows["id"], rows["status"], failed),
        outcome("orphan", orphan, none, rows["id"], rows["status"], unknown),
        outcome("timeout", passed, rows["id"], none, nothing, late),
    ]
    return [o for o in out if len(o["kind"])], _taken(rows, kept)


def settle(task: str | None, rows: list[tuple], cutoff: int) -> tuple[list[tuple], list[tuple]]:
    """``settled`` for one task; rows are (role, ts, id, deadline, status, error_msg)."""
    out, kept = settled(_columns([(task, *r) for r in rows], _HELD), cutoff)
    told = [tuple(None if x == _NO_ID else x for x in r) for o in out for r in zip(*(o[n].tolist() for n in _NAMES), strict=True)]
    return told, list(zip(*(kept[n].tolist() for n in _PARTS), strict=True))


def _track(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a bucket: its tasks' executions up to the clock, and their events after it, column by column."""
    none = _columns([], _HELD)
    arrived = none
    if not state.hasTimedOut:
        parts = [{n: p[n].to_numpy(object if n in _TEXTS else np.int64) for n in _HELD} for p in rows]
        arrived = _together(none, *parts)
        for column in (arrived[n] for n in _HELD if n in _TEXTS):
            column[pd.isna(column)] = None
    cutoff = state.getCurrentWatermarkMs() * 1000
    saved = json.loads(state.get[0]) if state.exists else [[[]] * len(_HELD)] * 2
    open_, held = ({n: np.array(c, none[n].dtype) for n, c in zip(_HELD, part, strict=True)} for part in saved)
    # First what the clock has settled without the rows that arrive now.
    due = held["ts"] <= cutoff
    out, kept = settled(_together(open_, _taken(held, due)), cutoff)
    now = arrived["ts"] <= cutoff
    if now.any():
        more, kept = settled(_together(kept, _taken(arrived, now)), cutoff)
        out += more
    wait = _together(_taken(held, ~due), _taken(arrived, ~now))
    if len(kept["ts"]) or len(wait["ts"]):
        state.update((json.dumps([[p[n].tolist() for n in _HELD] for p in (kept, wait)]),))
        ends = kept["deadline"][kept["deadline"] < _NO_LIMIT]
        times = np.concatenate([-(-wait["ts"] // 1000), ends // 1000 + 1])
        if len(times):
            # Runs out once the clock is past it: a millisecond earlier than due.
            state.setTimeoutTimestamp(max(int(times.min()) - 1, state.getCurrentWatermarkMs() + 1, 1))
    elif state.exists:
        state.remove()
    for told in out:
        ids = {n: pd.arrays.IntegerArray(told[n], told[n] == _NO_ID) for n in ("exec_id", "result_id")}
        yield pd.DataFrame({n: ids.get(n, told[n]) for n in _NAMES})


def wall_clock(spark: SparkSession) -> DataFrame:
    """A stream of ticks (timestamp), one a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select("timestamp")


def keyed_timeouts(executions: DataFrame, results: DataFrame, delay_seconds: int = 0, clock: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Executions and results as they come: rows of ``kind`` matched, orphan or timeout.

    The clock is the latest instant of all events and of the ticks of ``clock``
    (timestamp), less ``delay_seconds``, to the millisecond, as of the batches
    before. Rows wait until the clock reaches them, so inputs out of order by up
    to the delay are decided as ``match_results``, ``orphan_results`` and
    ``timed_out`` decide them; rows that come later still are decided when they
    come, and every result is in exactly one output. Limits are timers: with
    ``wall_clock`` they pass without further input.

    Tasks are dealt over ``buckets`` by a hash, and a bucket has one state and
    one timer: a batch costs a call for each bucket it touches, which reads and
    writes what that bucket's tasks have open. The number belongs to the
    checkpoint. Events without an instant are left out.
    """
    none = F.lit(None).cast("string")
    starts = executions.select(
        "task_id", F.lit(_EXECUTION).alias("role"), F.unix_micros("exec_ts").alias("ts"), F.coalesce(F.col("exec_id").cast("bigint"), F.lit(_NO_ID)).alias("id"),
        F.coalesce(deadline_micros(executions), F.lit(_NO_LIMIT)).cast("bigint").alias("deadline"), none.alias("status"), none.alias("error_msg"),
    )
    ends = results.select(
        "task_id", F.lit(_RESULT).alias("role"), F.unix_micros("result_ts").alias("ts"), F.coalesce(F.col("result_id").cast("bigint"), F.lit(_NO_ID)).alias("id"),
        F.lit(_NO_LIMIT).alias("deadline"), "status", "error_msg",
    )
    instants = executions.select(F.col("exec_ts").alias("mark")).unionByName(results.select(F.col("result_ts").alias("mark")))
    if clock is not None:
        instants = instants.unionByName(clock.select(F.col("timestamp").alias("mark")))
    # Only the watermark of these rows counts; events themselves are never late.
    hands = instants.withWatermark("mark", f"{delay_seconds} seconds").filter(F.col("mark") < F.lit("0001-01-02").cast("timestamp"))
    events = starts.unionByName(ends).filter("ts is not null").withColumn("mark", F.lit(_FAR).cast("timestamp"))
    rows = hands.unionByName(events, allowMissingColumns=True).withColumn("bucket", F.pmod(F.xxhash64("task_id"), F.lit(buckets)))
    keyed_session(rows.sparkSession)
    return rows.groupBy("bucket").applyInPandasWithState(_track, _OUTCOME, "rows string", "append", GroupStateTimeout.EventTimeTimeout)

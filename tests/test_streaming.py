"""Streams against their batch operators; restarts; the clock."""

from __future__ import annotations

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from joblog import streaming
from joblog.operators import outcomes, quota, state
from joblog.stream_queries import Replay

T0 = dt.datetime(2024, 1, 1)


def test_quota_windows_survive_restarts(spark):
    rows = [(i, T0 + dt.timedelta(seconds=7 * i, microseconds=i % 3), "g" if i % 3 else "h", i % 4) for i in range(240)]
    rows += [(1000, T0 + dt.timedelta(seconds=1), None, 1)]
    df = spark.createDataFrame(rows, "seq bigint, ts timestamp, rate_limit_group string, max_per_minute int")
    replay = Replay(df.filter("seq < 1000"), "seq")
    got = streaming.read_decided(spark, replay.decided(lambda root: streaming.stream_quota(replay.stream, root)))
    expected = quota.admit_quota(df.filter("seq < 1000"))
    assert sorted(got.collect()) == sorted(expected.collect())


def test_latest_state_replay_and_compaction(spark, tmp_path):
    rows = [(i, f"t{i % 9}", T0 if i % 11 == 0 else None) for i in range(100)]
    log = spark.createDataFrame(rows, "seq bigint, task_id string, deleted_at timestamp")
    root = str(tmp_path / "latest")
    with pytest.raises(ValueError):
        streaming.read_latest(spark, root)
    replay = Replay(log, "seq")
    replay.run(streaming.stream_latest(replay.stream, root))
    expected = sorted(state.latest_tasks(log).collect())
    assert sorted(streaming.read_latest(spark, root).collect()) == expected
    path = streaming.compact_latest(spark, root)
    assert streaming.compact_latest(spark, root) == path
    assert sorted(streaming.read_latest(spark, root).collect()) == expected
    # Another pass over the stream brings the same batches again, to the same deltas.
    again = Replay(log, "seq")
    again.run(streaming.stream_latest(again.stream, root))
    assert sorted(streaming.read_latest(spark, root).collect()) == expected
    more = spark.createDataFrame([(500, "t1", None), (501, "t2", T0)], log.schema)
    more.write.parquet(f"{root}/batch=000000000099")
    live = {r.task_id: r.seq for r in streaming.read_latest(spark, root).collect()}
    assert live["t1"] == 500 and "t2" not in live


def seconds(n: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=n)


def test_timeouts_fire_once_and_nothing_else_does(spark):
    # (id, task, time, limit or None, result?)
    events = [
        (0, "in time", 0, 10, None), (1, "in time", 10, None, "success"),
        (2, "late", 20, 5, None), (3, "late", 26, None, "success"),
        (4, "silent", 30, 5, None),
        (5, "replaced", 40, 50, None), (6, "replaced", 45, 50, None), (7, "replaced", 50, None, "failed"),
        (8, "twice", 60, None, None), (9, "twice", 61, None, "success"), (10, "twice", 62, None, "success"),
        (11, "unlimited", 63, None, None),
        (12, "far", 64, 500, None),
        (90, "end", 200, None, "success"),
    ]
    df = spark.createDataFrame(
        [(i, t, seconds(s), n, st) for i, t, s, n, st in events],
        "id bigint, task_id string, ts timestamp, max_execution_seconds bigint, status string",
    ).withColumn("error_msg", F.lit(None).cast("string"))

    def split(frame):
        executions = frame.filter("status is null").withColumnsRenamed({"id": "exec_id", "ts": "exec_ts"})
        results = frame.filter("status is not null").withColumnsRenamed({"id": "result_id", "ts": "result_ts"})
        return executions, results.drop("max_execution_seconds")

    replay = Replay(df, "id")
    rows = streaming.read_decided(spark, replay.decided(lambda root: streaming.stream_timeouts(*split(replay.stream), root))).collect()
    got = sorted((r.kind, r.exec_id, r.result_id) for r in rows if r.kind == "matched")
    assert got == [("matched", 0, 1), ("matched", 6, 7), ("matched", 8, 9)]
    assert sorted(r.result_id for r in rows if r.kind == "orphan") == [3, 10, 90]
    assert sorted(r.exec_id for r in rows if r.kind == "timeout") == [2, 4]
    batch = {r.exec_id for r in outcomes.timed_out(*split(df), as_of=seconds(200)).collect()}
    assert batch == {2, 4}


def feed(spark, tmp_path, pieces, schema, make):
    """Run ``make(stream, root)`` piece by piece, as restarts of one stream; returns its root."""
    folder, root = str(tmp_path / "in"), str(tmp_path / "root")
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    for i, rows in enumerate(pieces):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = own.readStream.schema(spark.createDataFrame([], schema).schema).parquet(folder)
        make(stream, root).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    return root


def test_late_rows_are_never_lost(spark, tmp_path):
    schema = "role string, task_id string, ts timestamp, id bigint, max_execution_seconds bigint, status string, error_msg string"
    start = lambda i, t, s, n: ("e", t, seconds(s), i, n, None, None)
    end = lambda i, t, s: ("r", t, seconds(s), i, None, "success", None)
    pieces = [
        [start(1, "a", 0, 10), start(2, "b", 290, 100), end(3, "z", 300)],
        [end(4, "a", 5), end(5, "z", 2), start(6, "c", 1, None), end(7, "b", 299)],
        [end(8, "c", 1), start(9, "b", 400, 5), end(10, "b", 500)],
    ]

    def split(frame):
        executions = frame.filter("role = 'e'").withColumnsRenamed({"id": "exec_id", "ts": "exec_ts"})
        return executions, frame.filter("role = 'r'").withColumnsRenamed({"id": "result_id", "ts": "result_ts"}).drop("max_execution_seconds")

    for delay, kinds in (
        (1000, {4: "matched", 3: "orphan", 5: "orphan", 7: "matched", 8: "matched", 10: "orphan", -9: "timeout"}),
        (0, {4: "orphan", 3: "orphan", 5: "orphan", 7: "matched", 8: "matched", 10: "orphan", -1: "timeout", -9: "timeout"}),
    ):
        place = tmp_path / str(delay)
        place.mkdir()
        root = feed(spark, place, pieces, schema, lambda s, r, d=delay: streaming.stream_timeouts(*split(s), r, d))
        rows = streaming.read_decided(spark, root).unionByName(streaming.held_outcomes(spark, root)).collect()
        assert len(rows) == len(kinds)
        assert {r.result_id or -r.exec_id: r.kind for r in rows} == kinds


def test_late_requests_count_in_the_window_that_stands(spark, tmp_path):
    schema = "seq bigint, ts timestamp, rate_limit_group string, max_per_minute int"
    pieces = [[(1, seconds(100), "g", 2)], [(2, seconds(10), "g", 2), (3, seconds(101), "g", 2), (4, seconds(5), "h", 1)], [(5, seconds(161), "g", 2), (6, seconds(6), "h", 1)]]
    root = feed(spark, tmp_path, pieces, schema, streaming.stream_quota)
    got = {r.seq: (r.ts, r.admitted) for r in streaming.read_decided(spark, root).collect()}
    assert got == {1: (seconds(100), True), 2: (seconds(10), True), 3: (seconds(101), False), 4: (seconds(5), True), 5: (seconds(161), True), 6: (seconds(6), False)}


def test_dedupe_state_survives_restarts_and_replays(spark, tmp_path):
    schema = "seq bigint, payload_key string, kind string"
    pieces = [[(1, "k", "enqueue"), (2, "j", "enqueue"), (3, None, "enqueue")], [(4, "k", "enqueue"), (5, "j", "done"), (6, "j", "enqueue")], [(7, "k", "done")], [(8, "k", "enqueue"), (9, "j", "enqueue")]]
    root = feed(spark, tmp_path, pieces, schema, streaming.stream_dedupe)
    got = {r.seq: r.accepted for r in streaming.read_decided(spark, root).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 6: True, 8: True, 9: False}


def test_compaction_recovers_from_a_crash_and_cleans_up(spark, tmp_path):
    root = str(tmp_path / "latest")
    for batch, rows in enumerate([[(1, "a", None), (2, "b", None)], [(3, "a", T0)], [(4, "c", None)]]):
        spark.createDataFrame(rows, "seq bigint, task_id string, deleted_at timestamp").write.parquet(f"{root}/batch={batch:012d}")
    (tmp_path / "latest" / "upto=000000000002").mkdir()  # a write that never finished
    (tmp_path / "latest" / "upto=000000000002" / "part-0").write_text("half")
    path = streaming.compact_latest(spark, root)
    assert {r.task_id for r in streaming.read_latest(spark, root).collect()} == {"b", "c"}
    assert streaming.remove_merged(spark, root, T0) == 0
    assert streaming.remove_merged(spark, root, dt.datetime(2100, 1, 1)) == 3
    assert path.endswith("upto=000000000002") and {r.task_id for r in streaming.read_latest(spark, root).collect()} == {"b", "c"}


def test_clock_brings_delayed_rows_due(spark, tmp_path):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [("past", now - dt.timedelta(seconds=60)), ("soon", now + dt.timedelta(seconds=4)), ("later", now + dt.timedelta(days=1))]
    tasks = spark.createDataFrame(rows, "task_id string, execute_at timestamp").withColumns(
        {
            "retry_after_time": F.col("execute_at"),
            "deleted_at": F.lit(None).cast("timestamp"),
            "urgency_score": F.lit(1.0),
            "rate_limit_group": F.lit(None).cast("string"),
            "max_per_minute": F.lit(None).cast("int"),
        }
    )
    windows = spark.createDataFrame([], "rate_limit_group string, count int, window_start timestamp")
    seen: list[set] = []
    query = streaming.stream_due(
        spark,
        lambda: tasks,
        lambda: windows,
        lambda decided, as_of, batch: seen.append({r.task_id for r in decided.filter("admitted").collect()}),
        str(tmp_path / "clock"),
        interval="1 second",
    ).start()
    try:
        until = time.time() + 60
        while time.time() < until and not (seen and seen[-1] == {"past", "soon"}):
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen[0] == {"past"} and seen[-1] == {"past", "soon"}


def test_messages_arrive_as_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"action":"progress","task_id":"a","data":"1"}\n\noops\n')
    stream = streaming.stream_messages(spark, str(folder))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run(df, where):
        df.writeStream.format("parquet").option("checkpointLocation", mark + where).trigger(availableNow=True).start(out + where).awaitTermination()
        return spark.read.parquet(out + where)

    assert run(stream, "0").filter("error is not null").count() == 1
    (folder / "b.jsonl").write_text('{"action":"progress","task_id":"a","data":"2"}\n')
    assert run(stream, "0").count() == 3
    assert sorted(r["data"] for r in run(streaming.stream_progress(stream), "1").collect()) == ["1", "2"]

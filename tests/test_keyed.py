"""Streams on Spark's keyed state: restarts, late rows, limits that pass by the clock."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from joblog import streaming
from joblog.operators import dedupe, quota
from joblog.streaming import keyed
from joblog.streaming.keyed import settle

T0 = dt.datetime(2024, 1, 1)
EVENTS = "role string, task_id string, ts timestamp, id bigint, max_execution_seconds bigint, status string, error_msg string"


def seconds(n: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=n)


@pytest.fixture
def own(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", "2")
    return session


def arrived(own, tmp_path, pieces, schema, make, ticks=None):
    """All rows of ``make(stream[, clock])``, piece by piece, as restarts of one stream; a tick comes with each piece."""
    folder, hand, out = (str(tmp_path / n) for n in ("in", "hand", "out"))
    shape = own.createDataFrame([], schema).schema
    for i, rows in enumerate(pieces):
        own.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = [own.readStream.schema(shape).parquet(folder)]
        if ticks:
            own.createDataFrame([(ticks[i],)], "timestamp timestamp").write.mode("append").parquet(hand)
            stream.append(own.readStream.schema("timestamp timestamp").parquet(hand))
        writer = make(*stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark"))
        writer.trigger(availableNow=True).start().awaitTermination()
    return own.read.parquet(out)


def split(frame):
    executions = frame.filter("role = 'e'").withColumnsRenamed({"id": "exec_id", "ts": "exec_ts"})
    return executions, frame.filter("role = 'r'").withColumnsRenamed({"id": "result_id", "ts": "result_ts"}).drop("max_execution_seconds")


def start(i, task, at, limit=None):
    return ("e", task, seconds(at), i, limit, None, None)


def end(i, task, at, status="success", error=None):
    return ("r", task, seconds(at), i, None, status, error)


def test_dedupe_survives_restarts_and_carries_columns(own, tmp_path):
    big = (1 << 62) + 1
    schema = "seq bigint, payload_key string, kind string, note bigint, at timestamp"
    pieces = [
        [(1, "k", "enqueue", big, T0), (2, "j", "enqueue", None, None), (3, None, "enqueue", 3, T0), (9, "j", "enqueue", big, T0)],
        [(14, "k", "enqueue", None, None), (16, "j", "enqueue", 1, T0), (15, "j", "done", 1, T0)],
        [(17, "k", "done", 1, T0)],
        [(19, "j", "enqueue", 1, T0), (18, "k", "enqueue", 1, seconds(0.000001))],
    ]
    rows = [r for p in pieces for r in p]
    got = arrived(own, tmp_path, pieces, schema, streaming.keyed_dedupe)
    want = dedupe.dedupe_in_flight(own.createDataFrame(rows, schema))
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_quota_survives_restarts_and_late_requests(own, tmp_path):
    schema = "seq bigint, ts timestamp, rate_limit_group string, max_per_minute int"
    pieces = [
        [(1, seconds(100), "g", 2), (8, seconds(1), None, 2), (9, seconds(1), "g", None)],
        [(2, seconds(10), "g", 2), (3, seconds(101), "g", 2), (4, seconds(5), "h", 1)],
        [(5, seconds(161), "g", 2), (6, seconds(6), "h", 1), (7, seconds(7), "z", 0)],
    ]
    rows = {r.seq: r for r in arrived(own, tmp_path, pieces, schema, streaming.keyed_quota).collect()}
    assert {k: (r.ts, r.admitted) for k, r in rows.items()} == {
        1: (seconds(100), True), 2: (seconds(10), True), 3: (seconds(101), False), 4: (seconds(5), True), 5: (seconds(161), True),
        6: (seconds(6), False), 7: (seconds(7), False), 8: (seconds(1), True), 9: (seconds(1), True),
    }
    assert rows[5].window_start == seconds(161) and rows[5].window_count == 1 and rows[8].window_start is None


def test_quota_in_order_equals_the_batch(own, tmp_path):
    schema = "seq bigint, ts timestamp, rate_limit_group string, max_per_minute int"
    rows = [(i, seconds(7 * i), "g" if i % 3 else "h", i % 4) for i in range(240)]
    got = arrived(own, tmp_path, [rows[:100], rows[100:130], rows[130:]], schema, streaming.keyed_quota)
    assert sorted(got.collect()) == sorted(quota.admit_quota(own.createDataFrame(rows, schema)).collect())


@pytest.mark.parametrize(
    ("delay", "kinds"),
    [
        (1000, {4: "matched", 3: "orphan", 5: "orphan", 7: "matched", 8: "matched", 10: "orphan", -9: "timeout"}),
        (0, {4: "orphan", 3: "orphan", 5: "orphan", 7: "matched", 8: "matched", 10: "orphan", -1: "timeout", -9: "timeout"}),
    ],
)
def test_late_rows_are_never_lost(own, tmp_path, delay, kinds):
    pieces = [
        [start(1, "a", 0, 10), start(2, "b", 290, 100), end(3, "z", 300)],
        [end(4, "a", 5), end(5, "z", 2), start(6, "c", 1), end(7, "b", 299)],
        [end(8, "c", 1), start(9, "b", 400, 5), end(10, "b", 500)],
        [],
    ]
    ticks = [seconds(0)] * 3 + [seconds(501 + delay)]
    rows = arrived(own, tmp_path, pieces, EVENTS, lambda s, c: streaming.keyed_timeouts(*split(s), delay, c), ticks).collect()
    assert len(rows) == len(kinds)
    assert {r.result_id or -r.exec_id: r.kind for r in rows} == kinds


def test_ticks_alone_let_limits_pass(own, tmp_path):
    pieces = [[start(1, "a", 0, 10), start(2, "b", 0, 1000), start(3, "c", 0), end(4, "d", 0, "failed")], [], [], [end(5, "b", 900, "failed", "why"), end(6, "c", 901, "failed")], []]
    ticks = [seconds(0), seconds(9), seconds(11), seconds(12), seconds(2000)]
    rows = arrived(own, tmp_path, pieces, EVENTS, lambda s, c: streaming.keyed_timeouts(*split(s), 0, c), ticks).collect()
    assert sorted((r.kind, r.task_id, r.exec_id, r.result_id, r.error) for r in rows if r.kind != "orphan") == [
        ("matched", "b", 2, 5, "why"), ("matched", "c", 3, 6, "Unknown error"), ("timeout", "a", 1, None, "Task execution timed out after 10 seconds"),
    ]
    assert [(r.result_id, r.error) for r in rows if r.kind == "orphan"] == [(4, "Received result for unknown/expired task_id d")]


def test_a_quiet_stream_reports_its_timeouts(own, tmp_path):
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    rows = [("e", "quiet", now, 1, 3, None, None), ("e", "patient", now, 2, 3600, None, None)]
    own.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(own.createDataFrame([], EVENTS).schema).parquet(str(tmp_path / "in"))
    tracked = streaming.keyed_timeouts(*split(stream), clock=streaming.wall_clock(own))
    query = tracked.writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and not own.table("quiet").count():
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(r.kind, r.task_id) for r in own.table("quiet").collect()] == [("timeout", "quiet")]


def test_settling_in_steps_is_settling_at_once():
    rows = [(0, 5, 1, 20, None, None), (0, 8, 2, 1 << 62, None, None), (1, 9, 3, 0, "success", None), (1, 9, 4, 0, "x", "y"), (0, 30, 5, 31, None, None)]
    whole, left = settle("t", rows, 100)
    for cut in (6, 8, 9, 30):
        first, kept = settle("t", [r for r in rows if r[1] <= cut], cut)
        then, rest = settle("t", kept + [r for r in rows if r[1] > cut], 100)
        assert sorted(map(str, first + then)) == sorted(map(str, whole)) and rest == left
    assert sorted(r[0] for r in whole) == ["matched", "orphan", "timeout"]


def test_a_bucket_serves_many_tasks_in_one_call(own, tmp_path, monkeypatch):
    rng = random.Random(3)
    limits = [rng.choice([None, 5, 60]) for _ in range(40)]
    rows = [start(i, f"t{i % 40}", rng.randint(0, 300), limits[i % 40]) if rng.random() < 0.5 else end(i, f"t{i % 40}", rng.randint(0, 300), rng.choice(["success", "failed"])) for i in range(900)]
    rows += [end(900, None, 7, "failed", "why"), start(901, None, 6)]
    rows.sort(key=lambda r: r[2])
    pieces = [rows[:300], rows[300:500], rows[500:], []]
    ticks = [seconds(0)] * 3 + [seconds(9000)]
    calls = tmp_path / "calls"
    whole = keyed._track

    def counted(key, parts, state):
        with open(calls, "a") as f:
            f.write("x")
        yield from whole(key, parts, state)

    monkeypatch.setattr(keyed, "_track", counted)
    got = arrived(own, tmp_path, pieces, EVENTS, lambda s, c: streaming.keyed_timeouts(*split(s), 60, c, buckets=1), ticks).collect()
    want = []
    for task in {r[1] for r in rows}:
        micros = lambda at: round((at - T0).total_seconds()) * 1_000_000
        own_rows = [(0 if r[0] == "e" else 1, micros(r[2]), r[3], micros(r[2]) + r[4] * 1_000_000 if r[4] else keyed._NO_LIMIT, r[5], r[6]) for r in rows if r[1] == task]
        want += settle(task, own_rows, 8000 * 1_000_000)[0]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    # Four pieces, a batch without input after each at most.
    assert len(calls.read_text()) <= 8

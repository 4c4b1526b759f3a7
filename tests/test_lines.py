"""Lines that are their own canonical form take a short way to the same rows; saved windows of any count cost one row."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from joblog.operators import quota
from joblog.queries import Views
from joblog.sources import messages, task_log

T0 = dt.datetime(2024, 1, 1)


def test_loose_lines_decode_like_canonical_ones(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    for lines, read in ((v.messages.select("seq", "value"), messages.decode_messages), (v.task_lines.select("seq", "value"), task_log.valid_log_rows)):
        loose = lines.withColumn("value", F.regexp_replace("value", r"^\{", "{ "))
        want, got = read(lines), read(loose)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 100


def test_canonical_looking_faults(spark):
    lines = [
        '{"action":"progress","task_id":"a","data":"x"}',  # good
        '{"action":"progress","task_id":5,"data":"x"}',
        '{"action":"progress","task_id":"a","data":"x"} ',  # good
        '{"action":"progress","task_id":"a","data":"x"}{}',
        '{"action":"progress","task_id":"a","task_id":"a","data":"x"}',
        '{"action":"progress","task_id":"\\u0061","data":"\\"x\\\\"}',  # good
        '{"data":"x","task_id":"a","action":"progress"}',  # good
        '{"action":"progress","task_id":"a","data":{"task_id":1}}',
    ]
    rows = spark.createDataFrame(list(enumerate(lines)), "seq long, value string")
    assert [r.seq for r in messages.decode_messages(rows).filter("error is null").orderBy("seq").collect()] == [0, 2, 5, 6]


def test_a_saved_count_costs_one_row(spark):
    schema = "seq bigint, ts timestamp, rate_limit_group string, max_per_minute int"
    at = lambda s: T0 + dt.timedelta(seconds=s)
    limit = 2**31 - 1
    requests = spark.createDataFrame([(1, at(5), "g", limit), (2, at(6), "g", 10), (3, at(61), "g", 1), (4, at(7), "h", 3), (5, at(8), "h", 3), (6, at(9), "z", 1)], schema)
    windows = spark.createDataFrame([("g", 2_000_000_000, T0), ("h", 2, T0), ("z", 0, T0), ("idle", 2_000_000_000, T0)], "rate_limit_group string, count int, window_start timestamp")
    for hot_rows in (10**6, 0):
        begun = time.time()
        got = {r.seq: (r.admitted, r.window_count, r.window_start) for r in quota.admit_quota(requests, windows=windows, hot_rows=hot_rows).collect()}
        assert got == {
            1: (True, 2_000_000_001, T0), 2: (False, 2_000_000_001, T0), 3: (True, 1, at(61)), 4: (True, 3, T0), 5: (False, 3, T0), 6: (True, 1, T0),
        }
        assert time.time() - begun < 60
    left = {r.rate_limit_group: (r["count"], r.window_start) for r in quota.rate_window_state(requests, windows=windows).collect()}
    assert left == {"g": (1, at(61)), "h": (3, T0), "z": (1, T0), "idle": (2_000_000_000, T0)}

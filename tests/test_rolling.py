"""Rolling quotas of a hot group, cut where a window was within its limits."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from joblog.operators import quota
from joblog.plans.ordered import cut, floor_div, hot_keys

SCHEMA = "seq bigint, ts timestamp, rate_limit_group string, max_per_minute int"
T0 = dt.datetime(2024, 1, 1)
WINDOW = 60


def model(rows):
    recent, out = defaultdict(deque), {}
    for seq, ts, group, limit in sorted(rows, key=lambda r: (r[1], r[0])):
        q = recent[group]
        while q and ts - q[0] >= dt.timedelta(seconds=WINDOW):
            q.popleft()
        out[seq] = len(q) < limit
        if out[seq]:
            q.append(ts)
    return out


def gapless(rng, minutes):
    """One request every 20 seconds at least, so no gap of a window; some minutes are far over the limit."""
    rows, seq = [], 0
    for minute in range(minutes):
        busy = rng.random() < 0.3
        for k in range(rng.randint(10, 30) if busy else 3):
            at = 20 * k if not busy else rng.uniform(0, 60)
            rows.append((seq, T0 + dt.timedelta(seconds=60 * minute + round(at, rng.choice([0, 6]))), "hot", rng.choice([4, 5, 6])))
            seq += 1
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    rows = gapless(rng, 50) + [(10_000 + i, T0 + dt.timedelta(seconds=37 * i), "calm", i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for per_slice in (1, 2, 4):
        got = {r.seq: r.admitted for r in quota.admit_quota(df, mode="rolling", hot_rows=0, windows_per_slice=per_slice).collect()}
        assert got == model(rows)
    assert {r.seq: r.admitted for r in quota.admit_quota(df, mode="rolling").collect()} == model(rows)


def test_a_gapless_group_runs_in_many_parts(spark):
    rows = gapless(random.Random(1), 200)
    df = spark.createDataFrame(rows, SCHEMA)
    width = span = WINDOW * 1_000_000
    stamped = cut(df.withColumn("__ts", F.unix_micros("ts")), ["rate_limit_group"], floor_div(F.unix_micros("ts"), span), hot_keys(df, ["rate_limit_group"], 0))
    parts = quota._rolling_bursts(stamped, width, span).groupBy("__burst").agg(F.count_if("__own").alias("own")).collect()
    assert sum(p.own for p in parts) == len(rows)
    assert len(parts) > 30 and max(p.own for p in parts) < len(rows) / 4


def dense(rng, n):
    """Many requests in every window, at instants of their own and shared ones; some without an instant."""
    rows = [(i, T0 + dt.timedelta(milliseconds=rng.randrange(300_000)), "hot", rng.choice([0, 2, 3, 40])) for i in range(n)]
    rows += [(n + i, T0 + dt.timedelta(seconds=rng.randrange(300)), "calm", 2) for i in range(100)]
    return rows


@pytest.mark.parametrize("hot_rows", [0, 10**6])
def test_trailing_counts_of_dense_windows(spark, hot_rows):
    rows = dense(random.Random(3), 600)
    df = spark.createDataFrame([*rows, (9000, None, "hot", 1), (9001, None, "hot", 1)], SCHEMA)
    want = {s: sum(g == h and t - dt.timedelta(seconds=WINDOW) < u <= t for _, u, h, _ in rows) for s, t, g, _ in rows}
    told = quota.rolling_rate(df, hot_rows=hot_rows, windows_per_slice=1)
    assert {r.seq: r.trailing for r in told.collect()} == want | {9000: 2, 9001: 2}
    for per_slice in (1, 4):
        got = quota.admit_quota(df.filter("ts is not null"), mode="rolling", hot_rows=hot_rows, windows_per_slice=per_slice)
        assert {r.seq: r.admitted for r in got.collect()} == model(rows)


def test_no_frame_slides(spark, capsys):
    """A sliding frame is counted anew wherever it moves, so its work grows with the square of a window's rows."""
    df = spark.createDataFrame(dense(random.Random(4), 50), SCHEMA)
    for told in (quota.rolling_rate(df, hot_rows=0), quota.admit_quota(df, mode="rolling", hot_rows=0)):
        told.explain()
        plan = capsys.readouterr().out
        assert "RangeFrame, unboundedpreceding$(), currentrow$()" in plan and "RangeFrame, -" not in plan

"""Ordered operators against sequential models, with slices so small that every path is cut."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import models
from joblog.functions.cron import next_tick, parse_cron
from joblog.operators import dedupe, outcomes, quota

EPOCH = dt.datetime(2024, 1, 1)


def at(us: int) -> dt.datetime:
    return EPOCH + dt.timedelta(microseconds=us)


BASE = int((EPOCH - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


def hot(rng: random.Random, keys: list):
    """A key; the first holds a third of all rows."""
    return keys[0] if rng.random() < 1 / 3 else rng.choice(keys)


@pytest.mark.parametrize("seed,chunk,hot_rows", [(1, 7, 0), (2, 1, 120), (3, 1000, 0), (4, 7, 10**6)])
def test_dedupe_in_flight(spark, seed, chunk, hot_rows):
    rng = random.Random(seed)
    events = [(i, hot(rng, ["a", "b", "c", None]), rng.choice(["enqueue", "enqueue", "done"])) for i in range(-50, 400)]
    df = spark.createDataFrame(events, "seq bigint, payload_key string, kind string").repartition(5)
    got = {r.seq: r.accepted for r in dedupe.dedupe_in_flight(df, chunk_rows=chunk, hot_rows=hot_rows).collect()}
    assert got == models.dedupe(events)


SECOND = 1_000_000


def gaps(rng: random.Random, style: str) -> int:
    if style == "edges":
        return rng.choice([0, 59_999_999, 60_000_000, 60_000_001, SECOND])
    if style == "steady":
        return rng.choice([0, SECOND, 3 * SECOND, 7 * SECOND + 1])
    if style == "dense":
        return rng.randrange(0, 400_000)
    return int(rng.expovariate(1 / 30) * SECOND)


@pytest.mark.parametrize("style", ["edges", "steady", "dense", "random"])
@pytest.mark.parametrize("per_slice,per_stretch,hot_rows", [(1, 2, 0), (2, 5, 600), (1, 64, 0), (16, 1, 0), (16, 64, 10**6)])
def test_admit_quota_anchored(spark, style, per_slice, per_stretch, hot_rows):
    rng = random.Random(f"{style}{per_slice}{per_stretch}")
    requests, us = [], BASE
    for seq in range(1500):
        us += gaps(rng, style)
        requests.append((us, seq, hot(rng, ["g", "h", "i"]), rng.choice([2, 2, 5, 0, -1, 30])))
    df = spark.createDataFrame(
        [(at(us - BASE), seq, g, n) for us, seq, g, n in requests],
        "ts timestamp, seq bigint, rate_limit_group string, max_per_minute int",
    ).repartition(6)
    rows = quota.admit_quota(
        df, windows_per_slice=per_slice, slices_per_stretch=per_stretch, hot_rows=hot_rows
    ).collect()
    got = {r.seq: (r.admitted, int((r.window_start - EPOCH).total_seconds() * 1e6 + 0.5) + BASE, r.window_count) for r in rows}
    assert got == models.quota(requests, 60 * SECOND)


@pytest.mark.parametrize("hot_rows", [0, 400, 10**6])
@pytest.mark.parametrize("style", ["edges", "steady", "random"])
def test_admit_quota_rolling(spark, style, hot_rows):
    rng = random.Random(style)
    requests, us = [], BASE
    for seq in range(900):
        us += gaps(rng, style)
        requests.append((us, seq, hot(rng, ["g", "h"]), rng.choice([2, 3, 0])))
    df = spark.createDataFrame(
        [(at(us - BASE), seq, g, n) for us, seq, g, n in requests],
        "ts timestamp, seq bigint, rate_limit_group string, max_per_minute int",
    ).repartition(6)
    rows = quota.admit_quota(df, mode="rolling", windows_per_slice=2, hot_rows=hot_rows).collect()
    assert {r.seq: r.admitted for r in rows} == models.rolling(requests, 60 * SECOND)
    trailing = {r.seq: r.trailing for r in quota.rolling_rate(df, windows_per_slice=2, hot_rows=hot_rows).collect()}
    for us, seq, group, _ in requests[::37]:
        assert trailing[seq] == sum(g == group and us - 60 * SECOND < t <= us for t, _, g, _ in requests)


def test_unlimited_requests_pass(spark):
    df = spark.createDataFrame(
        [(at(0), 1, None, 1), (at(0), 2, "g", None), (at(1), 3, "g", 0)],
        "ts timestamp, seq bigint, rate_limit_group string, max_per_minute int",
    )
    got = {r.seq: (r.admitted, r.window_count) for r in quota.admit_quota(df).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 0)}


@pytest.mark.parametrize("mixed", [False, True])
def test_admit_due(spark, mixed):
    rng = random.Random(mixed)
    rows = []
    for i in range(600):
        group = hot(rng, ["g", "h", "i", None])
        limit = rng.choice([None, 0, 3, 40, 90]) if mixed else {"g": 50, "h": 0, "i": 7, None: 3}[group]
        rows.append((f"t{i}", group, limit, rng.choice([None, 0.5, -1.0, 2.0]), at(rng.randrange(5))))
    prior = {"g": 4, "i": 9}
    df = spark.createDataFrame(
        rows, "task_id string, rate_limit_group string, max_per_minute int, urgency_score double, execute_at timestamp"
    ).repartition(7)
    now = at(100 * SECOND)
    windows = spark.createDataFrame(
        [("g", 4, at(40 * SECOND + 1)), ("h", 100, at(40 * SECOND)), ("i", 9, now)],
        "rate_limit_group string, count int, window_start timestamp",
    )
    got = {r.task_id: r.admitted for r in quota.admit_due(df, windows, now).collect()}
    assert got == models.admit_due(rows, prior)


def test_pace_backlog(spark):
    rng = random.Random(5)
    limits = {"g": 7, "h": 0, "i": -2}
    rows = [(f"t{i:04d}", hot(rng, list(limits)), rng.choice([None, 0.5, 0.5]), at(rng.randrange(3))) for i in range(500)]
    rows = [(t, g, limits[g], u, e) for t, g, u, e in rows]
    df = spark.createDataFrame(
        rows, "task_id string, rate_limit_group string, max_per_minute int, urgency_score double, execute_at timestamp"
    ).repartition(5)
    expected, ranks = {}, {}
    for task, group, limit, _, _ in sorted(rows, key=lambda r: (-(r[3] or 0.0), r[4], r[0])):
        ranks[group] = ranks.get(group, 0) + 1
        slot = (ranks[group] - 1) // limit if limit > 0 else None
        expected[task] = (ranks[group], slot, None if slot is None else at(60 * SECOND * slot))
    free = spark.createDataFrame([("x", None, 5, None, at(0)), ("y", "g", None, 1.0, at(0))], df.schema)
    expected |= {"x": (None, 0, at(0)), "y": (None, 0, at(0))}
    for hot_rows in (20, 1_000_000):
        paced = quota.pace_backlog(df.unionByName(free), at(0), hot_rows=hot_rows)
        assert {r.task_id: (r.queue_rank, r.slot, r.planned_time) for r in paced.collect()} == expected


def attempt_rows(rng: random.Random, tasks: int, n: int):
    rows, us = [], 0
    for _ in range(n):
        us += rng.choice([1, SECOND, 45 * SECOND, 200 * SECOND])
        ok = rng.random() < 0.3
        rows.append((hot(rng, [f"t{i}" for i in range(tasks)]), at(us), ok, None if ok else f"e{us}", ok and rng.random() < 0.5))
    return rows


@pytest.mark.parametrize("chunk,hot_rows", [(1, 0), (60, 40), (100_000, 0), (60, 10**6)])
def test_number_attempts_and_summary(spark, chunk, hot_rows):
    rng = random.Random(chunk + hot_rows)
    cut = {"chunk_seconds": chunk, "hot_rows": hot_rows}
    rows = attempt_rows(rng, 12, 400)
    df = spark.createDataFrame(
        rows, "task_id string, attempt_ts timestamp, ok boolean, error_msg string, restarts boolean"
    ).repartition(5)
    by_task: dict[str, list] = {}
    for row in rows:
        by_task.setdefault(row[0], []).append(row)
    numbered = {(r.task_id, r.attempt_ts): (r.attempt_no, r.retry_count) for r in outcomes.number_attempts(df, **cut).collect()}
    for task, own in by_task.items():
        for row, n in zip(own, models.numbers([r[4] for r in own])):
            assert numbered[task, row[1]] == (n, n - 1)
    plain = outcomes.number_attempts(df, restarts=None, **cut)
    assert plain.agg(F.sum("attempt_no")).first()[0] == sum(len(o) * (len(o) + 1) // 2 for o in by_task.values())
    limits = {f"t{i}": i - 2 for i in range(14)}
    limits["t0"] = 10_000
    tasks = spark.createDataFrame(list(limits.items()), "task_id string, max_retries int")
    got = {r.task_id: (r.attempts, r.failures, r.last_error, r.outcome) for r in outcomes.attempt_summary(tasks, df, **cut).collect()}
    assert got == {t: models.attempts_of([(r[2], r[3]) for r in by_task.get(t, [])], m) for t, m in limits.items()}


@pytest.mark.parametrize("chunk,hot_rows", [(1, 0), (60, 40), (100_000, 0), (60, 10**6)])
def test_apply_attempts(spark, chunk, hot_rows):
    rng = random.Random(chunk * 3 + hot_rows)
    history = [row[:4] for row in attempt_rows(rng, 14, 500)]
    crons = [None, "0 */10 * * * *", "0 0 0 30 2 *", "nonsense", "0 30 0 1 1 * 2024"]
    known = {f"t{i}": (rng.randrange(3), rng.randrange(5), crons[i % 5]) for i in range(1, 13)}
    known["t0"] = (0, 6, crons[1])  # the hot task, restarted again and again
    known["t12"] = (0, 3, None)  # has no attempts
    gone = {"t3"}
    df = spark.createDataFrame([(t, *k, t in gone) for t, k in known.items()], "task_id string, retry_count int, max_retries int, cron_expression string, gone boolean")
    own = F.to_timestamp(F.lit("2023-01-01"))
    tasks = df.select(
        "task_id", "retry_count", "max_retries", "cron_expression", F.lit(0.5).alias("retry_after_hours"), own.alias("execute_at"),
        own.alias("retry_after_time"), F.lit("own").alias("last_error_obj"), F.when(F.col("gone"), own).alias("deleted_at"),
    )
    attempts = spark.createDataFrame(history, "task_id string, attempt_ts timestamp, ok boolean, error_msg string").repartition(5)
    moved = outcomes.apply_attempts(tasks, attempts, chunk_seconds=chunk, hot_rows=hot_rows)
    assert moved.columns == [*tasks.columns, "transition", "attempts"] and moved.schema["retry_count"].dataType.simpleString() == "int"
    year = dt.datetime(2023, 1, 1)

    def tick(cron, ts):
        fields = parse_cron(cron)
        return fields and next_tick(fields, ts)

    expected = models.attempts({t: k for t, k in known.items() if t not in gone}, history, tick)
    got = {
        r.task_id: (
            r.transition, r.attempts, r.retry_count, "own" if r.execute_at == year else r.execute_at,
            "own" if r.retry_after_time == year else r.retry_after_time - dt.timedelta(minutes=30), r.deleted_at, r.last_error_obj,
        )
        for r in moved.collect()
    }
    assert got == expected and {v[0] for v in got.values()} >= {"completed", "dead"}
    assert outcomes.apply_attempts(tasks, attempts.filter("false")).count() == 0


@pytest.mark.parametrize("chunk,hot_rows", [(1, 0), (30, 100), (100_000, 0), (30, 10**6)])
def test_results_find_their_executions(spark, chunk, hot_rows):
    rng = random.Random(chunk + hot_rows)
    executions, results, us = [], [], 0
    for i in range(400):
        us += rng.choice([0, SECOND, 5 * SECOND, 40 * SECOND])
        task = hot(rng, ["a", "b", "c", "d"])
        if rng.random() < 0.5:
            limit = rng.choice([None, 5, 40])
            executions.append((i, task, at(us), limit, "u" if rng.random() < 0.1 else None))
        else:
            results.append((i, task, at(us), rng.choice(["success", "failed"]), None))
    ex = spark.createDataFrame(
        executions, "exec_id bigint, task_id string, exec_ts timestamp, max_execution_seconds bigint, webhook_url string"
    ).repartition(4)
    rs = spark.createDataFrame(
        results, "result_id bigint, task_id string, result_ts timestamp, status string, error_msg string"
    ).repartition(3)
    matched, late = {}, set()
    for task in "abcd":
        m, l = models.pair(
            [(e[0], e[2], None if e[3] is None or e[4] else e[2] + dt.timedelta(seconds=e[3])) for e in executions if e[1] == task],
            [(r[0], r[2]) for r in results if r[1] == task],
        )
        matched |= m
        late |= l
    got = {r.result_id: r.exec_id for r in outcomes.match_results(ex, rs, chunk, hot_rows).collect()}
    assert got == matched
    assert {r.result_id for r in outcomes.orphan_results(ex, rs, chunk, hot_rows).collect()} == {r[0] for r in results} - set(matched)
    assert {r.exec_id for r in outcomes.timed_out(ex, rs, chunk_seconds=chunk, hot_rows=hot_rows).collect()} == late
    now = at(us // 2)
    ends = {e[0]: e[2] + dt.timedelta(seconds=e[3]) for e in executions if e[3] is not None}
    by_now = {r.exec_id for r in outcomes.timed_out(ex, rs, as_of=now, chunk_seconds=chunk, hot_rows=hot_rows).collect()}
    assert by_now == {i for i in late if ends[i] < now}


def test_progress_keeps_every_chunk(spark):
    rows = [("hot" if i % 3 else "cold", i, f"<{i}>") for i in range(300)]
    df = spark.createDataFrame(rows, "task_id string, seq bigint, data string").repartition(6)
    parts = outcomes.assemble_progress(df, part_chunks=32, chunk_rows=50, hot_rows=100).collect()
    last = {r.task_id: (r.chunks, r.last_data) for r in outcomes.progress_summary(df).collect()}
    for task in ("hot", "cold"):
        own = sorted((p for p in parts if p.task_id == task), key=lambda p: p.part)
        expected = [d for t, _, d in rows if t == task]
        assert "".join(p.text for p in own) == "".join(expected)
        assert last[task] == (len(expected), expected[-1])
        assert [p.part for p in own] == list(range(len(own)))
        assert sum(p.chunks for p in own) == len(expected)
        assert all(p.chunks <= 32 for p in own)

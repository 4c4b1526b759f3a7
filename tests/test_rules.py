"""Edge tables: log lines, messages, cron texts, times, outcomes, retries."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from joblog.functions.cron import next_tick, normalize_cron, parse_cron
from joblog.functions.payload import payload_key
from joblog.functions.rfc3339 import parse_rfc3339
from joblog.operators import dedupe, dispatch, handlers, metrics, outcomes, quota, schedule, state, tasks
from joblog.sources import messages, rate_windows, task_log
from joblog.sources.line_order import in_file_order

GOOD = {
    "taskId": "a",
    "retryCount": 0,
    "maxRetries": 3,
    "retryAfterHours": 0.5,
    "retryAfterTime": "2024-01-01T00:00:00Z",
    "taskData": '{"to":"x, \\"taskId\\": 5"}',
    "taskType": "mail",
    "executeAt": "2024-01-01T00:00:00.250Z",
}


def line(**changes) -> str:
    record = {**GOOD, **changes}
    return json.dumps({k: v for k, v in record.items() if v != "drop"})


BAD_LINES = [
    "",
    "   ",
    "\t",
    line()[:-10],
    "not json",
    "[]",
    "5",
    line() + " x",
    line(taskId=5),
    line(taskData={"a": 1}),
    line(taskType=None),
    line(retryCount="1"),
    line(retryCount=1.5),
    line(retryCount=2**31),
    line(executeAt="2024-01-01"),
    line(executeAt="2024-01-01T00:00:00"),
    line(retryAfterTime="2024-13-01T00:00:00Z"),
    line(deletedAt="yesterday"),
    line(maxExecutionSeconds=-1),
    line(maxExecutionSeconds=2**63),
    line(LastErrorObj=7),
    line(LastJobError={"error": "x"}),
    line(autoDedupe="true"),
    line().replace("0.5", "NaN"),
    *[line(**{k: "drop"}) for k in GOOD],
]
GOOD_LINES = [
    line(taskId="plain"),
    line(taskId="extra", unknown={"taskId": "z"}),
    line(taskId="offset", executeAt="2024-01-01T02:00:00+02:00"),
    line(taskId="options", urgencyScore=1, maxExecutionSeconds=2**63 - 1, LastJobError={"error": "x", "retry_worthy": True}),
    line(taskId="nulls", webhookUrl=None, deletedAt=None, LastErrorObj=None),
    "  " + line(taskId="spaces") + "  ",
]


def test_task_log_lines(spark):
    df = spark.createDataFrame([(v,) for v in BAD_LINES], "value string")
    assert task_log.valid_log_rows(df).select("task_id").collect() == []
    df = spark.createDataFrame([(v,) for v in GOOD_LINES], "value string")
    rows = {r.task_id: r for r in task_log.valid_log_rows(df).collect()}
    assert set(rows) == {"plain", "extra", "offset", "options", "nulls", "spaces"}
    assert rows["offset"].execute_at == dt.datetime(2024, 1, 1)
    assert rows["plain"].execute_at == dt.datetime(2024, 1, 1, 0, 0, 0, 250_000)
    assert rows["plain"].task_data == GOOD["taskData"]
    assert rows["options"].max_execution_seconds == 2**63 - 1
    assert rows["options"].last_job_error == ("x", True)


def test_log_order_across_splits(spark, tmp_path):
    path = tmp_path / "tasks.log"
    path.write_text("\n".join(line(taskId=f"t{i % 7}", retryCount=i) for i in range(3000)) + "\n" + line(taskId="t3", deletedAt="2024-01-02T00:00:00Z"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        log = task_log.read_task_log(spark, str(path))
        assert log.rdd.getNumPartitions() > 4
        got = {r.task_id: r.retry_count for r in state.latest_tasks(log).collect()}
        health = state.log_health(log).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"t{i % 7}": i for i in range(2993, 3000) if i % 7 != 3}
    assert (health.live_lines, health.tombstone_lines, health.appends) == (3000, 1, 3001)
    assert health.bytes == path.stat().st_size and not health.should_compact


def test_broken_bytes_cost_one_line(spark, tmp_path):
    path = tmp_path / "tasks.log"
    lines = [line(taskId="a"), line(taskId="b", taskData="x"), line(taskId="c")]
    path.write_bytes("\n".join(lines).encode().replace(b'"x"', b'"\xff\xfe"'))
    assert sorted(r.task_id for r in task_log.read_task_log(spark, str(path)).collect()) == ["a", "c"]
    path.write_bytes(b'{"action":"register","task_type":"\xc3\x28"}\n{"action":"stats"}')
    rows = messages.read_messages(spark, str(path)).collect()
    assert sorted((r.action, r.error is None) for r in rows if r.action) == [("stats", True)] and len(rows) == 2


def test_id_lives_again_after_its_tombstone(spark):
    versions = [(1, "a", None), (2, "a", dt.datetime(2024, 1, 1)), (3, "a", None), (4, "b", None), (5, "b", dt.datetime(2024, 1, 1))]
    log = spark.createDataFrame(versions, "seq bigint, task_id string, deleted_at timestamp")
    assert [(r.task_id, r.seq) for r in state.latest_tasks(log).collect()] == [("a", 3)]
    ids = spark.createDataFrame([("a",), ("zz",)], "task_id string")
    gone = state.delete_tasks(state.latest_tasks(log), ids, "2024-02-01 00:00:00").withColumn("seq", F.lit(9).cast("bigint"))
    assert [r.task_id for r in gone.collect()] == ["a"]
    assert state.upsert_tasks(state.latest_tasks(log), gone).count() == 0


def test_compaction_keeps_the_state(spark, tmp_path):
    versions = [(i, f"t{i % 5}", dt.datetime(2024, 1, 1) if i % 5 == 2 else None) for i in range(40)]
    log = spark.createDataFrame(versions, "seq bigint, task_id string, deleted_at timestamp")
    root = str(tmp_path / "log")
    first = task_log.compact_log(log, root)
    assert sorted(spark.read.parquet(first).collect()) == sorted(state.latest_tasks(log).collect())
    more = spark.read.parquet(first).unionByName(spark.createDataFrame([(99, "t0", dt.datetime(2024, 2, 1))], log.schema))
    second = task_log.compact_log(more, root)
    assert second > first and spark.read.parquet(second).count() == 3
    assert task_log.compact_log(log.filter("deleted_at is null"), root, only_if_due=True) is None


def test_messages(spark):
    bad = [
        '{"action":"enqueue","task_id":',
        '{"task_id":"a"}',
        '{"action":"explode"}',
        '{"action":"register"}',
        '{"action":"register","task_type":5}',
        '{"action":"progress","task_id":"a"}',
        '{"action":"result","task_id":"a","status":true}',
        '{"action":"enqueue","task_id":"a","task_type":"t","task_data":"d","max_retries":"3","retry_after_hours":1}',
        '{"action":"enqueue","task_id":"a","task_type":"t","task_data":"d","max_retries":3}',
        '{"action":"enqueue","task_id":"a","task_type":"t","task_data":"d","max_retries":3,"retry_after_hours":1,"max_execution_seconds":-4}',
        "{'action':'stats'}",
        "null",
    ]
    good = [
        '{"action":"stats"}',
        '{"action":"stats","unknown":[1]}',
        '{"action":"register","task_type":"t"}',
        '{"action":"result","task_id":"a","status":"success"}',
        '{"action":"enqueue","task_id":"a","task_type":"t","task_data":"d","max_retries":3,"retry_after_hours":0.001,"execute_at":null}',
    ]
    df = spark.createDataFrame([(v,) for v in bad + ["", "  "]], "value string")
    rows = messages.decode_messages(df).collect()
    assert len(rows) == len(bad)
    assert all(r.action is None and r.task_id is None and r.error.startswith("Invalid JSON: ") for r in rows)
    rows = messages.decode_messages(spark.createDataFrame([(v,) for v in good], "value string")).collect()
    assert [r.action for r in rows] == ["stats", "stats", "register", "result", "enqueue"]
    assert all(r.error is None for r in rows)


def test_outbound_messages_and_requests(spark):
    df = spark.createDataFrame(
        [("a", "t", '{"k":"v"}', 30, "https://x"), ("b", "t", "d", None, None)],
        "task_id string, task_type string, task_data string, max_execution_seconds bigint, webhook_url string",
    )
    first, second = (json.loads(r.value) for r in messages.encode_messages(df, "execute").collect())
    assert first == {"action": "execute", "task_id": "a", "task_type": "t", "task_data": '{"k":"v"}', "max_execution_seconds": 30}
    assert "max_execution_seconds" not in second
    request = messages.webhook_outbox(df, messages.MAX_RETRIES_REACHED, event_header="X-Event").collect()
    assert len(request) == 1 and request[0].url == "https://x"
    assert request[0].headers == {"Content-Type": "application/json", "X-Event": "MaxRetriesReached"}
    assert json.loads(request[0].body) == {"taskId": "a", "taskType": "t", "data": '{"k":"v"}'}


def test_rate_windows_round_trip(spark, tmp_path):
    rows = [("g", 3, dt.datetime(2024, 1, 1, 1, 2, 3, 456789)), ("h", 0, dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "rate_limit_group string, count int, window_start timestamp")
    path = str(tmp_path / "w")
    rate_windows.encode_rate_windows(df).write.text(path)
    assert sorted(rate_windows.read_rate_windows(spark, path).collect()) == sorted(df.collect())
    root = str(tmp_path / "saved")
    assert rate_windows.load_rate_windows(spark, root).count() == 0
    rate_windows.save_rate_windows(df.limit(1), root)
    rate_windows.save_rate_windows(df, root)
    assert rate_windows.load_rate_windows(spark, root).count() == 2
    (tmp_path / "bad.json").write_text("{broken")
    assert rate_windows.read_rate_windows(spark, str(tmp_path / "bad.json")).count() == 0


CRON_TEXTS = {
    "10m": "0 */10 * * * *",
    "2h": "0 0 */2 * * *",
    "1d": "0 0 0 */1 * *",
    "30s": "*/30 * * * * *",
    " 5m ": "0 */5 * * * *",
    "05m": "0 */5 * * * *",
    "+5m": "0 */5 * * * *",
    "-5m": "-5m",
    "5 m": "5 m",
    "m": "m",
    "4294967295s": "*/4294967295 * * * * *",
    "4294967296s": "4294967296s",
    "99999999999999999999999999999999999999999999s": "99999999999999999999999999999999999999999999s",
    "0 * * * *": "0 0 * * * * *",
    "\t0 9 * * 1\n": "0 0 9 * * 1 *",
    "0 0 9 * * 1": "0 0 9 * * 1 *",
    "0 0 9 * * 1 2030": "0 0 9 * * 1 2030",
    "": "",
    "  ": "",
}


def test_normalize_cron(spark):
    df = spark.createDataFrame([(k,) for k in CRON_TEXTS], "c string")
    got = {r.c: r.n for r in df.select("c", normalize_cron(F.col("c")).alias("n")).collect()}
    assert got == CRON_TEXTS


def utc(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize(
    "expression,after,tick",
    [
        ("0 */10 * * * *", "2024-01-01 00:10:00", "2024-01-01 00:20:00"),
        ("0 */10 * * * *", "2024-01-01 00:09:59.999999", "2024-01-01 00:10:00"),
        ("0 0 0 31 * *", "2024-01-31 00:00:00", "2024-03-31 00:00:00"),
        ("0 0 0 29 2 *", "2024-02-29 00:00:00", "2028-02-29 00:00:00"),
        ("0 0 0 29 FEB Thu *", "2024-02-28 00:00:00", "2024-02-29 00:00:00"),
        ("0 0 0 1 1 * 2020", "2024-01-01 00:00:00", None),
        ("0 0 0 30 2 *", "2024-01-01 00:00:00", None),
        ("59 59 23 31 12 *", "2023-12-31 23:59:58.5", "2023-12-31 23:59:59"),
        ("0 0 12 ? * MON-FRI", "2024-01-05 12:00:00", "2024-01-08 12:00:00"),
        ("5/20 0 0 * * *", "2024-01-01 00:00:25", "2024-01-01 00:00:45"),
        ("0 0 9-17/4,23 * * *", "2024-01-01 17:00:00", "2024-01-01 23:00:00"),
        ("0 0 0 * * 1", "2024-01-01 00:00:00", "2024-01-07 00:00:00"),
    ],
)
def test_next_tick(expression, after, tick):
    assert next_tick(parse_cron(expression), utc(after)) == (utc(tick) if tick else None)


@pytest.mark.parametrize(
    "bad", ["", "* * * * *", "60 * * * * *", "*/90 * * * * *", "*/0 * * * * *", "5-1 * * * * *", "a * * * * *", "0 0 0 0 * *", "* * * * * 8", "*-5 * * * * *", "1,,2 * * * * *"]
)
def test_bad_cron(bad):
    assert parse_cron(bad) is None


def test_cron_expand_matches_next_tick(spark):
    crons = ["0 */7 * * * *", "*/45 59 23 * * *", "0 0 0 1,15 * Mon", "bad", "0 30 4 29 2 ?"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(crons)], "schedule_id bigint, cron_expression string")
    start, end = utc("2024-02-28 23:10:00"), utc("2024-04-01 00:07:00")
    got = sorted((r.schedule_id, r.tick) for r in schedule.cron_expand(df, start, end).select("schedule_id", "tick").collect())
    expected = []
    for i, cron in enumerate(crons):
        fields, tick = parse_cron(cron), start - dt.timedelta(microseconds=1)
        while fields and (tick := next_tick(fields, tick)) and tick < end:
            expected.append((i, tick))
    assert got == sorted(expected)
    assert schedule.cron_expand(df, end, end).count() == 0


NOW = "2024-01-31 09:07:30"


def test_resolve_execute_at(spark):
    cases = [
        ("good", "2024-05-01T10:00:00.5-02:00", None, "2024-05-01 12:00:00.5"),
        ("good lower", "2024-05-01t10:00:00z", None, "2024-05-01 10:00:00"),
        ("bad with cron", "soon", "10m", NOW),
        ("empty with cron", "", "10m", NOW),
        ("cron", None, "10m", "2024-01-31 09:10:00"),
        ("bad cron", None, "61 * * * *", NOW),
        ("never", None, "0 0 0 30 2 *", NOW),
        ("neither", None, None, NOW),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "id string, execute_at string, cron string")
    got = {r.id: r.execute_at for r in tasks.resolve_execute_at(df, NOW).collect()}
    assert got == {c[0]: utc(c[3]) for c in cases}


def test_rfc3339(spark):
    cases = {"2024-01-01T00:00:00Z": True, "2024-01-01 00:00:00+00:00": True, "2024-01-01": False, "2024-01-01T00:00Z": False, "2024-01-01T25:00:00Z": False, "2024-01-01T00:00:00": False}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v is not None for r in df.select("t", parse_rfc3339(F.col("t")).alias("v")).collect()} == cases


def test_build_tasks(spark):
    line = '{"action":"enqueue","task_id":"a","task_type":"t","task_data":"d","max_retries":3,"retry_after_hours":0.5,"cron":"2h","auto_dedupe":true}'
    decoded = messages.decode_messages(spark.createDataFrame([(line,)], "value string"))
    row = tasks.build_tasks(tasks.route_messages(decoded, "enqueue"), NOW).first()
    assert (row.retry_count, row.retry_after_time, row.execute_at) == (0, utc(NOW), utc("2024-01-31 10:00:00"))
    assert row.cron_expression == "0 0 */2 * * *" and row.deleted_at is None and len(row.payload_hash) == 64


def test_payload_key(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "t string, d string")
    plain, compat = (df.select(payload_key(F.col("t"), F.col("d"), compat=c)).distinct().count() for c in (False, True))
    assert (plain, compat) == (2, 1)


def test_classify_outcomes(spark):
    rows = [
        ("a", "success", None, None, None, None, None),
        ("b", "Success", None, None, None, None, "Unknown error"),
        ("c", "failed", "boom", None, None, None, "boom"),
        ("d", None, None, 200, "OK", None, None),
        ("e", None, None, 299, None, None, None),
        ("f", None, None, 199, None, None, "Webhook returned non-2xx status: 199 <unknown status code>"),
        ("g", None, None, 404, None, None, "Webhook returned non-2xx status: 404 Not Found"),
        ("i", None, None, 404, "Gone fishing", None, "Webhook returned non-2xx status: 404 Gone fishing"),
        ("h", None, None, None, None, "refused", "Webhook request failed: refused"),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "id string, status string, error_msg string, http_status int, http_reason string, http_error string")
    got = {r.id: (r.ok, r.error) for r in tasks.classify_outcomes(df).collect()}
    assert got == {r[0]: (r[6] is None, r[6]) for r in rows}


def test_retry_bounds(spark):
    rows = [(f"{c}/{m}", c, m) for c in range(3) for m in (-(2**31), -1, 0, 1, 2, 3, 2**31 - 1)]
    df = spark.createDataFrame(rows, "task_id string, retry_count int, max_retries int")
    assert {r.task_id for r in tasks.retry_eligible(df).collect()} == {i for i, c, m in rows if c < m - 1}
    assert {r.task_id for r in tasks.exhausted(df).collect()} == {i for i, c, m in rows if c >= m - 1}


def test_next_retry_truncates(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", -0.0005), ("c", 1e300), ("d", float("nan"))], "task_id string, retry_after_hours double").withColumn("retry_count", F.lit(1))
    rows = {r.task_id: r for r in tasks.next_retry(df.filter("task_id in ('a', 'b', 'd')"), F.lit("x"), NOW).collect()}
    assert rows["a"].retry_after_time == utc("2024-01-31 09:07:33") and rows["a"].retry_count == 2
    assert rows["b"].retry_after_time == utc("2024-01-31 09:07:29")
    assert rows["d"].retry_after_time == utc(NOW)
    assert rows["a"].last_job_error == ("x", True)
    assert tasks.next_retry(df.limit(1), F.lit(None).cast("string"), NOW).first().last_job_error is None


def test_priority_order(spark):
    rows = [("b", None), ("a", 0.0), ("c", -1.0), ("d", 5.0)]
    df = spark.createDataFrame([(t, u, utc(NOW)) for t, u in rows], "task_id string, urgency_score double, execute_at timestamp")
    assert [r.task_id for r in dispatch.priority_order(df).collect()] == ["d", "a", "b", "c"]
    assert [r.task_id for r in dispatch.dispatch_batch(df, 2).collect()] == ["d", "a"]


def task_frame(spark):
    rows = [("ok", 0, 3, None), ("cron", 1, 3, "0 */10 * * * *"), ("never", 0, 3, "0 0 0 30 2 *"), ("retry", 0, 3, None), ("dead", 2, 3, None), ("idle", 0, 3, None), ("hook", 0, 0, None)]
    df = spark.createDataFrame([(*r[:3], r[3], "t", "d", "https://x" if r[0] == "hook" else None) for r in rows], "task_id string, retry_count int, max_retries int, cron_expression string, task_type string, task_data string, webhook_url string")
    return df.withColumns(
        {
            "retry_after_hours": F.lit(0.5),
            "execute_at": tasks.instant(NOW),
            "retry_after_time": tasks.instant(NOW),
            "last_error_obj": F.lit("old"),
            "last_job_error": F.struct(F.lit("old").alias("error"), F.lit(True).alias("retry_worthy")),
            "deleted_at": F.lit(None).cast("timestamp"),
        }
    )


def test_apply_results(spark):
    ok = {"ok": True, "cron": True, "never": True, "retry": False, "dead": False, "hook": False}
    results = spark.createDataFrame([(k, v, None if v else "boom") for k, v in ok.items()], "task_id string, ok boolean, error string")
    rows = {r.task_id: r for r in outcomes.apply_results(task_frame(spark), results, NOW).collect()}
    assert {k: r.transition for k, r in rows.items()} == {"ok": "completed", "cron": "rescheduled", "never": "completed", "retry": "retry", "dead": "dead", "hook": "dead"}
    assert rows["cron"].execute_at == utc("2024-01-31 09:10:00") and rows["cron"].last_error_obj is None and rows["cron"].retry_count == 0
    assert rows["retry"].retry_after_time == utc("2024-01-31 09:37:30") and rows["retry"].last_error_obj == "boom"
    assert rows["dead"].last_error_obj == "old" and rows["dead"].deleted_at == utc(NOW)
    letters = {r.task_id: r.route for r in outcomes.dead_letters(task_frame(spark), results).collect()}
    assert letters == {"dead": "message", "hook": "webhook"}


def test_summary_equals_repeated_transitions(spark):
    """A6 on recorded attempts = T1 applied attempt by attempt."""
    history = {"a": [False, False, True], "b": [False, False, False, True], "c": [True], "d": [False]}
    rows = [(t, dt.datetime(2024, 1, 1, 0, i), ok, None if ok else f"{t}{i}", False) for t, h in history.items() for i, ok in enumerate(h)]
    attempts = spark.createDataFrame(rows, "task_id string, attempt_ts timestamp, ok boolean, error_msg string, restarts boolean")
    ids = F.explode(F.array(*[F.lit(t) for t in history]))
    current = task_frame(spark).filter("task_id = 'ok'").withColumn("task_id", ids)
    summary = {r.task_id: (r.attempts, r.outcome) for r in outcomes.attempt_summary(current, attempts).collect()}
    final = {}
    for i in range(4):
        step = attempts.filter(F.minute("attempt_ts") == i).select("task_id", "ok", F.col("error_msg").alias("error"))
        moved = outcomes.apply_results(tasks.live_tasks(current), step, NOW)
        for r in moved.collect():
            final[r.task_id] = (i + 1, {"completed": "succeeded", "retry": "pending", "dead": "dead"}[r.transition])
        moved = moved.drop("transition")
        rest = current.join(moved.select("task_id"), "task_id", "left_anti").select(*moved.columns)
        current = spark.createDataFrame(moved.unionByName(rest).collect(), moved.schema)
    assert summary == final


def test_handlers(spark):
    df = spark.createDataFrame([("1", "good", None), ("2", "bad", None), ("3", "none", None), ("4", "good", "https://x")], "task_id string, task_type string, webhook_url string")

    def fail(task):
        raise RuntimeError(f"no {task['task_id']}")

    table = {"good": lambda task: None, "bad": fail}
    rows = {r.task_id: (r.ok, r.error) for r in handlers.run_handlers(df, table).collect()}
    assert rows == {"1": (True, None), "2": (False, "no 2")}
    assert {r.task_id for r in handlers.run_max_retry_handlers(df, table).collect()} == {"1", "2"}


def test_registered_types_split_the_rows(spark):
    types = spark.range(20).select(F.concat(F.lit("t"), "id").alias("task_type"))
    df = spark.createDataFrame([("1", "t3", None), ("2", "x", None), ("3", None, None), ("4", "x", "u")], "task_id string, task_type string, webhook_url string")
    assert {r.task_id for r in outcomes.dispatchable(df, types).collect()} == {"1", "4"}
    assert {r.task_id for r in outcomes.unregistered(df, types).collect()} == {"2", "3"}


def test_drop_active_payloads(spark):
    df = spark.createDataFrame([("1", "k"), ("2", "j"), ("3", None), ("k", None)], "task_id string, payload_hash string")
    active = spark.createDataFrame([("k",)], "payload_hash string")
    assert {r.task_id for r in dedupe.drop_active_payloads(df, active).collect()} == {"2", "3", "k"}


def test_queue_stats_without_executions(spark):
    lines = ['{"action":"result","task_id":"a","status":"success"}', '{"action":"result","task_id":"a","status":"no"}', "oops"]
    df = spark.createDataFrame([(i, utc(NOW) + dt.timedelta(seconds=i, microseconds=i), v) for i, v in enumerate(lines)], "seq bigint, event_ts timestamp, value string")
    tasks_df = task_frame(spark)
    row = metrics.queue_stats(messages.decode_messages(df), tasks_df).first()
    assert tuple(row) == (0, 1, 1, 0, 7, 2)


GOOD_LINE = '{"taskId":"a","retryCount":0,"maxRetries":3,"retryAfterHours":0.5,"retryAfterTime":"2024-01-01T00:00:00Z","taskData":"d","taskType":"t","executeAt":"2024-01-01T00:00:00Z"%s}'


@pytest.mark.parametrize(
    "tail,good",
    [
        *((f',"extra":{{"taskId":{value},"taskData":{value}}}', True) for value in ("5", '"s"', "null", "true", "[1]", '{"taskId":1}', "1.5")),
        (',"extra":[{"taskType":1}]', True),
        (',"x":"{\\"taskId\\":5}"', True),
        (',"payloadHash":null', True),
        (',"payloadHash":5', False),
        (',"taskId":"b"', False),
        (',"x":1}{"y":2', False),
        (',"x":1},{"y":2', False),
        (',"x":1}] [{"y":2', False),
        (',"x":1},1,{"y":2', False),
        (",'x':1", False),
        (',"x":NaN', False),
    ],
)
def test_only_top_level_keys_decide(spark, tail, good):
    log = spark.createDataFrame([(GOOD_LINE % tail,)], "value string")
    assert task_log.valid_log_rows(log).count() == int(good)
    line = '{"action":"result","task_id":"a","status":"success"' + tail.replace("taskId", "task_id").replace("taskData", "status").replace("payloadHash", "error_msg") + "}"
    row = messages.decode_messages(spark.createDataFrame([(line,)], "value string")).first()
    assert (row.error is None) == good and (row.task_id == "a") == good


def test_leap_seconds(spark):
    df = spark.createDataFrame([("2016-12-31T23:59:60Z",), ("2016-12-31T23:59:60.25+00:00",), ("2016-12-31T23:59:61Z",)], "t string")
    got = [r.v for r in df.select(F.unix_micros(parse_rfc3339(F.col("t"))).alias("v")).collect()]
    assert got == [1483228800000000, 1483228800250000, None]


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    for name, n in (("b.txt", 40_000), ("a.txt", 30_000), ("c.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name[0]}{i:06d}\n" for i in range(n)))
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    own.conf.set("spark.sql.files.openCostInBytes", "1")
    lines = in_file_order(own.read.text(str(tmp_path)))
    rows = [(r.seq, r.value) for r in lines.select("seq", "value").collect()]
    assert len({s for s, _ in rows}) == 70_003 and [v for _, v in sorted(rows)] == sorted(v for _, v in rows)
    assert lines.select(F.spark_partition_id()).distinct().count() > 1


def test_first_line_of_saved_windows_counts_whole_or_not(spark, tmp_path):
    window = '{"count":2,"window_start":"2024-01-01T00:00:00Z"}'
    for i, (text, n) in enumerate([(f'{{"g":{window},"h":{window}}}\n{{"g":{window}}}\n', 2), (f'{{"g":{window},"h":{{"count":1}}}}', 0), ("oops", 0), ("", 0)]):
        (tmp_path / f"w{i}").write_text(text)
        assert rate_windows.read_rate_windows(spark, str(tmp_path / f"w{i}")).count() == n
    windows = spark.createDataFrame([("g", 1, dt.datetime(2024, 1, 1)), ("h", 0, dt.datetime(2024, 1, 2))], "rate_limit_group string, count int, window_start timestamp")
    rate_windows.encode_rate_windows(windows).write.text(str(tmp_path / "out"))
    assert sorted(map(tuple, rate_windows.read_rate_windows(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, windows.collect()))


@pytest.mark.parametrize("hot", [1, 1_000_000])
def test_quota_goes_on_from_saved_windows(spark, hot):
    start = dt.datetime(2024, 1, 1)
    at = lambda s: start + dt.timedelta(seconds=s)
    windows = spark.createDataFrame([("a", 2, at(0)), ("b", 0, at(0)), ("c", 5, at(-100)), ("z", 1, at(0))], "rate_limit_group string, count int, window_start timestamp")
    rows = [(i, at(s), g, n) for i, (s, g, n) in enumerate([(1, "a", 3), (2, "a", 3), (59, "a", 3), (60, "a", 3), (1, "b", 1), (61, "b", 1), (0, "c", 5), (5, "new", 1), (6, "new", 1), (7, None, 1)])]
    requests = spark.createDataFrame(rows, "seq bigint, ts timestamp, rate_limit_group string, max_per_minute int")
    got = {r.seq: r.admitted for r in quota.admit_quota(requests, hot_rows=hot, windows=windows).collect()}
    assert got == dict(enumerate([True, False, False, True, True, True, True, True, False, True]))
    state_rows = {r.rate_limit_group: (r["count"], r.window_start) for r in quota.rate_window_state(requests, windows=windows).collect()}
    assert state_rows == {"a": (1, at(60)), "b": (1, at(61)), "c": (1, at(0)), "new": (1, at(5)), "z": (1, at(0))}


def test_dedupe_goes_on_from_active_keys(spark):
    events = spark.createDataFrame([(1, "k", "enqueue"), (2, "k", "done"), (3, "k", "enqueue"), (4, "j", "enqueue"), (5, None, "enqueue")], "seq bigint, payload_key string, kind string")
    active = spark.createDataFrame([("k",), (None,), ("x",)], "payload_hash string")
    for hot in (1, 1_000_000):
        got = {r.seq: r.accepted for r in dedupe.dedupe_in_flight(events, active, chunk_rows=2, hot_rows=hot).collect()}
        assert got == {1: False, 3: True, 4: True, 5: True}
    assert {r.payload_key for r in dedupe.active_keys(events).collect()} == {"k", "j"}

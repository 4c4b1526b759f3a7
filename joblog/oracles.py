"""DuckDB twins of the queries, in another form than the Spark side where there is one."""

from __future__ import annotations

from joblog.fixtures import EVENT_AS_OF, QUOTA_WINDOW, TASK_AS_OF, TICKS_FROM, TICKS_TO, duckdb_view
from joblog.operators.tasks import HTTP_REASONS, UNKNOWN_REASON

W = QUOTA_WINDOW * 1_000_000
ORDER = "attempt_ts, k1, k2, k3, k4, k5"


def _sql(body: str, *views: str, steps: str = "", recursive: bool = False) -> str:
    parts = [f"{name} AS (\n{duckdb_view(name)}\n)" for name in views]
    if steps:
        parts.append(steps.strip())
    if not parts:
        return body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


LOG = """task_id, task_type, task_data, cast(retry_count AS bigint) AS retry_count,
  cast(max_retries AS bigint) AS max_retries, epoch_us(execute_at) AS execute_at, payload_hash,
  epoch_us(deleted_at) AS deleted_at"""
TASK = """task_id, task_type, urgency_score, epoch_us(execute_at) AS execute_at, rate_limit_group,
  cast(max_per_minute AS bigint) AS max_per_minute"""
BOUNDS = "cast(retry_count AS bigint) AS retry_count, cast(max_retries AS bigint) AS max_retries"
REASON = "CASE http_status {} ELSE '{}' END".format(
    " ".join(f"WHEN {code} THEN '{text.replace(chr(39), chr(39) * 2)}'" for code, text in HTTP_REASONS.items()), UNKNOWN_REASON
)
PRIORITY = "coalesce(urgency_score, 0.0) DESC, execute_at, task_id"

LATEST = """latest AS (
  SELECT * FROM fx_task_log a
  WHERE seq = (SELECT max(seq) FROM fx_task_log b WHERE b.task_id = a.task_id) AND deleted_at IS NULL)"""
DUE = f"""due AS (
  SELECT * FROM fx_tasks WHERE deleted_at IS NULL AND NOT in_flight
    AND greatest(execute_at, retry_after_time) <= TIMESTAMP '{TASK_AS_OF}')"""
FIRST = f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {ORDER}) AS no FROM fx_attempts),
firsts AS (SELECT task_id, ok, error_msg FROM numbered WHERE no = 1)"""
DEAD = f"""{FIRST},
dead AS (
  SELECT t.task_id, t.task_type, t.task_data, t.webhook_url,
         CASE WHEN t.webhook_url IS NULL THEN 'message' ELSE 'webhook' END AS route, f.error_msg AS error
  FROM fx_tasks t JOIN firsts f ON f.task_id = t.task_id
  WHERE NOT f.ok AND t.deleted_at IS NULL AND t.max_retries - t.retry_count <= 1)"""
PAIRS = """pairs AS (
  SELECT r.*, e.exec_id, e.exec_ts,
         CASE WHEN e.webhook_url IS NULL THEN e.exec_ts + to_seconds(e.max_execution_seconds) END AS deadline,
         row_number() OVER (PARTITION BY e.exec_id ORDER BY r.result_ts, r.result_id) AS turn
  FROM fx_results r ASOF LEFT JOIN {executions} e ON e.task_id = r.task_id AND r.result_ts >= e.exec_ts),
matched AS (
  SELECT * FROM pairs WHERE exec_id IS NOT NULL AND turn = 1 AND (deadline IS NULL OR result_ts <= deadline))"""
DIRECT = "direct AS (SELECT * FROM fx_executions WHERE webhook_url IS NULL)"
STATS = f"""{LATEST}, {DEAD}, {DIRECT}, {PAIRS.format(executions='direct')},
stats AS (
  SELECT (SELECT count(*) FROM events WHERE event_type = 'signup' AND event_id % 50 <> 7) AS total_enqueued,
         (SELECT count(*) FROM matched WHERE status = 'success') AS total_executed,
         (SELECT count(*) FROM matched WHERE status <> 'success') AS total_failed,
         (SELECT count(*) FROM dead WHERE webhook_url IS NULL) AS total_dlq,
         (SELECT count(*) FROM latest) AS queue_depth,
         (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 FROM events) AS uptime_secs)"""
# The results that were decodable messages.
STATS_VIEWS = ("fx_task_log", "fx_tasks", "fx_attempts", "fx_executions")
RESULTS_AS_MESSAGES = f"fx_results AS ({duckdb_view('fx_results')} AND event_id % 50 <> 7)"


def _fold(source: str, order: str, width: int = W) -> str:
    """Sequential admission, one row of every group per step."""
    return f"""r AS (
  SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY rate_limit_group ORDER BY {order}) AS rn FROM {source}),
f AS (
  SELECT rate_limit_group AS g, rn, us AS start, CASE WHEN max_per_minute > 0 THEN 1 ELSE 0 END AS n,
         max_per_minute > 0 AS admitted FROM r WHERE rn = 1
  UNION ALL
  SELECT g, r.rn, CASE WHEN r.us - start >= {width} THEN r.us ELSE start END,
         CASE WHEN r.us - start >= {width} THEN 0 ELSE n END
           + CASE WHEN (CASE WHEN r.us - start >= {width} THEN 0 ELSE n END) < r.max_per_minute THEN 1 ELSE 0 END,
         (CASE WHEN r.us - start >= {width} THEN 0 ELSE n END) < r.max_per_minute
  FROM f JOIN r ON r.rate_limit_group = f.g AND r.rn = f.rn + 1)"""


def _admitted(view: str) -> str:
    return _sql(
        """SELECT seq, us AS ts, rate_limit_group, cast(max_per_minute AS bigint) AS max_per_minute, f.admitted,
  f.start AS window_start, cast(f.n AS bigint) AS window_count
FROM r JOIN f ON f.g = r.rate_limit_group AND f.rn = r.rn""",
        view,
        steps=_fold(view, "ts, seq"),
        recursive=True,
    )


LATE = """SELECT exec_id, task_id, epoch_us(exec_ts) AS exec_ts, epoch_us(exec_ts) + max_execution_seconds * 1000000 AS deadline,
  'Task execution timed out after ' || max_execution_seconds || ' seconds' AS error
FROM fx_executions e WHERE webhook_url IS NULL AND max_execution_seconds IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM fx_results r WHERE r.task_id = e.task_id AND r.result_ts >= e.exec_ts
    AND r.result_ts <= e.exec_ts + to_seconds(e.max_execution_seconds))"""

SAVED = """saved AS (
  SELECT DISTINCT rate_limit_group AS g, CASE WHEN cast(substr(rate_limit_group, 2) AS int) % 3 = 0 THEN 0
         ELSE 2 * cast(substr(rate_limit_group, 2) AS int) END AS used
  FROM fx_tasks WHERE rate_limit_group IS NOT NULL)"""
ADMITTED_DUE = f"""{DUE}, {SAVED},
ranked AS (
  SELECT due.*, row_number() OVER (PARTITION BY rate_limit_group, max_per_minute IS NULL ORDER BY {PRIORITY}) AS place
  FROM due),
ticked AS (
  SELECT ranked.*, rate_limit_group IS NULL OR max_per_minute IS NULL OR place + used <= max_per_minute AS admitted
  FROM ranked LEFT JOIN saved ON g = rate_limit_group)"""


def _expected_execute_at(prefix: str = "") -> str:
    now = f"TIMESTAMP '{EVENT_AS_OF}'"
    return f"""CASE event_id % 5
    WHEN 1 THEN TIMESTAMP '2024-02-01 00:30:00' + to_hours(event_id % 10)
    WHEN 3 THEN TIMESTAMP '2024-01-31 22:30:00.5' + to_hours(event_id % 10)
    WHEN 0 THEN CASE user_id % 4 WHEN 0 THEN date_trunc('hour', {now}) + INTERVAL 10 MINUTE
                                 WHEN 1 THEN date_trunc('hour', {now}) + INTERVAL 1 HOUR ELSE {now} END
    ELSE {now} END"""


TICK_RULE = """CASE s_suppkey % 6 WHEN 0 THEN second(t) = 0 AND minute(t) % 10 = 0
       WHEN 1 THEN second(t) = 0 AND minute(t) = 0 AND hour(t) % 2 = 0
       WHEN 2 THEN second(t) = 0 AND minute(t) = 0
       WHEN 3 THEN second(t) = 0 AND minute(t) % 15 = 0 AND hour(t) BETWEEN 9 AND 17
       WHEN 4 THEN second(t) = 0 AND minute(t) = 0 AND hour(t) = 0 ELSE true END"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    # sources and sinks
    o["read_task_log"] = _sql(f"SELECT {LOG} FROM fx_task_log", "fx_task_log")
    o["append_task_log"] = _sql(f"SELECT seq, {LOG} FROM fx_task_log", "fx_task_log")
    o["valid_log_rows"] = """SELECT event_id AS seq, cast(user_id AS string) AS task_id,
  'type' || cast(user_id % 5 AS string) AS task_type, 'd' || cast(event_id AS string) AS task_data,
  cast(event_id % 3 AS bigint) AS retry_count, cast(3 AS bigint) AS max_retries,
  epoch_us(CASE WHEN event_id % 50 = 13 THEN TIMESTAMP '2024-01-02 00:30:00' ELSE TIMESTAMP '2024-01-02 00:00:00.25' END)
    AS execute_at, cast(NULL AS string) AS payload_hash,
  CASE WHEN event_type = 'purchase' THEN epoch_us(TIMESTAMP '2024-01-03 00:00:00') END AS deleted_at
FROM events WHERE event_id % 50 NOT BETWEEN 7 AND 12"""
    o["read_messages"] = """SELECT
  CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'progress' WHEN 'view' THEN 'register' ELSE 'result' END AS action,
  CASE WHEN event_type <> 'view' THEN cast(user_id AS string) END AS task_id,
  CASE WHEN event_type IN ('signup', 'view') THEN 'type' || cast(user_id % 5 AS string) END AS task_type,
  CASE WHEN event_type = 'signup' THEN 'd' || cast(event_id AS string) END AS task_data,
  CASE WHEN event_type = 'signup' THEN cast(3 AS bigint) END AS max_retries,
  CASE WHEN event_type = 'signup' THEN 0.5e0 END AS retry_after_hours,
  CASE WHEN event_type = 'signup' THEN user_id % 2 = 0 END AS auto_dedupe,
  CASE WHEN event_type = 'click' THEN 'c' || cast(event_id AS string) END AS data,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' END AS status,
  cast(NULL AS string) AS error
FROM events WHERE event_id % 50 <> 7
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Invalid JSON: not a readable object' FROM events WHERE event_id % 50 = 7"""
    o["compact_task_log"] = _sql(f"SELECT seq, {LOG} FROM latest", "fx_task_log", steps=LATEST)
    o["read_rate_windows"] = o["rate_window_state"] = _sql(
        """SELECT g AS rate_limit_group, cast(arg_max(n, rn) AS bigint) AS count, arg_max(start, rn) AS window_start
FROM f GROUP BY g""",
        "fx_requests",
        steps=_fold("fx_requests", "ts, seq"),
        recursive=True,
    )
    o["encode_messages"] = _sql(
        """SELECT '{"action":"ack","task_id":"' || cast(user_id AS string) || '","message":"Enqueued successfully"}' AS value
FROM events WHERE event_type = 'signup' AND event_id % 50 <> 7
UNION ALL SELECT '{"action":"ack","message":"Registered handler for type' || cast(user_id % 5 AS string) || '"}'
FROM events WHERE event_type = 'view' AND event_id % 50 <> 7
UNION ALL SELECT '{"action":"progress","task_id":"' || cast(user_id AS string) || '","data":"c' || cast(event_id AS string) || '"}'
FROM events WHERE event_type = 'click' AND event_id % 50 <> 7
UNION ALL SELECT '{"action":"error","message":"Invalid JSON: not a readable object"}' FROM events WHERE event_id % 50 = 7
UNION ALL SELECT '{"action":"execute","task_id":"' || task_id || '","task_type":"' || task_type || '","task_data":"'
  || replace(task_data, '"', '\\"') || '"' || CASE WHEN retry_count > 0
  THEN ',"max_execution_seconds":' || cast(retry_count * 60 AS string) ELSE '' END || '}' FROM due
  WHERE webhook_url IS NULL AND task_type IN (SELECT 'type' || cast(user_id % 5 AS string) FROM events WHERE event_type = 'view' AND event_id % 50 <> 7)
UNION ALL SELECT '{"action":"error","task_id":"' || task_id || '","message":"Received result for unknown/expired task_id ' || task_id || '"}'
FROM fx_results WHERE result_id NOT IN (SELECT result_id FROM matched)
UNION ALL SELECT '{"action":"max_retries_reached","task_id":"' || task_id || '","task_type":"' || task_type || '","task_data":"'
  || replace(task_data, '"', '\\"') || '"}' FROM dead WHERE webhook_url IS NULL
UNION ALL SELECT '{"action":"stats","total_enqueued":' || total_enqueued || ',"total_executed":' || total_executed
  || ',"total_failed":' || total_failed || ',"total_dlq":' || total_dlq || ',"queue_depth":' || queue_depth || ',"uptime_secs":'
  || uptime_secs || '}' FROM stats""",
        *STATS_VIEWS,
        steps=f"{RESULTS_AS_MESSAGES}, {DUE}, {STATS}",
    )
    o["webhook_outbox"] = _sql(
        """SELECT task_id, webhook_url AS url, 'application/json' AS content_type, 'Execute' AS event,
  '{"taskId":"' || task_id || '","taskType":"' || task_type || '","data":"' || replace(task_data, '"', '\\"') || '"}' AS body
FROM due WHERE webhook_url IS NOT NULL""",
        "fx_tasks",
        steps=DUE,
    )
    o["union_task_logs"] = _sql(
        f"""SELECT CASE WHEN seq % 2 = 0 THEN 'even' ELSE 'odd' END AS source, seq, {LOG} FROM fx_task_log
WHERE deleted_at IS NULL AND seq IN (SELECT max(seq) FROM fx_task_log GROUP BY task_id, seq % 2)""",
        "fx_task_log",
    )

    # projections
    o["build_tasks"] = f"""SELECT event_id AS seq, cast(user_id AS string) AS task_id,
  'type' || cast(user_id % 5 AS string) AS task_type, 'd' || cast(event_id AS string) AS task_data,
  cast(0 AS bigint) AS retry_count, cast(3 AS bigint) AS max_retries, 0.5e0 AS retry_after_hours,
  epoch_us(TIMESTAMP '{EVENT_AS_OF}') AS retry_after_time, epoch_us(TIMESTAMP '{EVENT_AS_OF}') AS execute_at,
  CASE WHEN user_id % 2 = 0 THEN sha256('5:type' || cast(user_id % 5 AS string) || 'd' || cast(event_id AS string)) END
    AS payload_hash, cast(NULL AS bigint) AS deleted_at
FROM events WHERE event_type = 'signup' AND event_id % 50 <> 7"""
    o["resolve_execute_at"] = f"""SELECT event_id AS seq, cast(user_id AS string) AS task_id,
  epoch_us({_expected_execute_at()}) AS execute_at,
  CASE WHEN event_id % 5 IN (0, 2) THEN CASE user_id % 4 WHEN 0 THEN '10m' WHEN 1 THEN '2h' WHEN 2 THEN 'not a cron' END END AS cron
FROM events"""
    o["payload_key"] = """SELECT doc_id AS seq,
  CASE WHEN doc_id % 10 <> 0 THEN sha256(cast(length(source) AS string) || ':' || source || text) END AS payload_key,
  sha256(source || text) AS compat_key FROM documents"""
    o["normalize_cron"] = """SELECT o_orderkey AS cron_id, CASE o_orderkey % 10
  WHEN 0 THEN '*/' || o_custkey || ' * * * * *' WHEN 1 THEN '0 */' || o_custkey || ' * * * *'
  WHEN 2 THEN '0 0 */' || o_custkey || ' * * *' WHEN 3 THEN '0 0 0 */' || o_custkey || ' * *'
  WHEN 4 THEN CASE WHEN o_custkey * 4000000 < 4294967296 THEN '*/' || (o_custkey * 4000000) || ' * * * * *'
                   ELSE (o_custkey * 4000000) || 's' END
  WHEN 5 THEN o_custkey || ' m' WHEN 6 THEN '0 ' || (o_custkey % 60) || '  * * * * *'
  WHEN 7 THEN '0 ' || (o_custkey % 60) || ' 9-17 * * Mon *' WHEN 8 THEN '0 0 0 1 1 * 2030'
  ELSE o_orderpriority END AS cron_expression FROM orders"""
    o["next_retry"] = _sql(
        f"""SELECT task_id, cast(retry_count + 1 AS bigint) AS retry_count,
  epoch_us(TIMESTAMP '{TASK_AS_OF}') + cast(trunc(retry_after_hours * 3600.0) AS bigint) * 1000000 AS retry_after_time,
  CASE WHEN retry_count > 1 THEN 'again' END AS last_error_obj, CASE WHEN retry_count > 1 THEN 'again' END AS job_error,
  CASE WHEN retry_count > 1 THEN true END AS retry_worthy FROM fx_tasks""",
        "fx_tasks",
    )
    o["tombstone"] = _sql(
        f"SELECT * REPLACE (epoch_us(TIMESTAMP '{EVENT_AS_OF}') AS deleted_at) FROM (SELECT seq, {LOG} FROM latest)",
        "fx_task_log",
        steps=LATEST,
    )
    o["classify_outcomes"] = _sql(
        f"""SELECT outcome_id, error IS NULL AS ok, error FROM (
  SELECT outcome_id, CASE WHEN status = 'success' THEN NULL WHEN status IS NOT NULL THEN coalesce(error_msg, 'Unknown error')
    WHEN http_status IS NULL THEN 'Webhook request failed: ' || http_error
    WHEN http_status // 100 = 2 THEN NULL ELSE 'Webhook returned non-2xx status: ' || http_status || ' ' || {REASON} END AS error
  FROM fx_outcomes)""",
        "fx_outcomes",
    )

    # filters
    o["live_tasks"] = _sql(f"SELECT {TASK} FROM fx_tasks WHERE deleted_at IS NULL", "fx_tasks")
    o["due_tasks"] = _sql(f"SELECT {TASK} FROM due", "fx_tasks", steps=DUE)
    o["retry_eligible"] = _sql(f"SELECT task_id, {BOUNDS} FROM fx_tasks WHERE max_retries - retry_count > 1", "fx_tasks")
    o["exhausted"] = _sql(f"SELECT task_id, {BOUNDS} FROM fx_tasks WHERE max_retries - retry_count <= 1", "fx_tasks")
    o["quota_bound"] = _sql(
        f"SELECT {TASK} FROM fx_tasks WHERE NOT (rate_limit_group IS NULL OR max_per_minute IS NULL)", "fx_tasks"
    )
    o["get_latest_task"] = _sql(f"SELECT seq, {LOG} FROM latest WHERE task_id = '8'", "fx_task_log", steps=LATEST)
    o["route_messages"] = """SELECT event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'progress' WHEN 'view' THEN 'register' ELSE 'result' END AS action,
  CASE WHEN event_type <> 'view' THEN cast(user_id AS string) END AS task_id,
  CASE event_type WHEN 'signup' THEN 'd' || cast(event_id AS string) WHEN 'click' THEN 'c' || cast(event_id AS string)
    WHEN 'view' THEN 'type' || cast(user_id % 5 AS string) WHEN 'purchase' THEN 'success' ELSE 'failed' END AS detail
FROM events WHERE event_id % 50 <> 7"""

    # joins
    o["exclude_in_flight"] = _sql(f"SELECT {TASK} FROM fx_tasks WHERE NOT in_flight", "fx_tasks")
    pairs = PAIRS.format(executions="fx_executions")
    result = "result_id, task_id, epoch_us(result_ts) AS result_ts, status, error_msg"
    o["match_results"] = _sql(
        f"SELECT {result}, exec_id, epoch_us(exec_ts) AS exec_ts FROM matched", "fx_executions", "fx_results", steps=pairs
    )
    o["orphan_results"] = _sql(
        f"""SELECT {result}, 'Received result for unknown/expired task_id ' || task_id AS message
FROM fx_results WHERE result_id NOT IN (SELECT result_id FROM matched)""",
        "fx_executions",
        "fx_results",
        steps=pairs,
    )
    o["timed_out"] = _sql(
        LATE,
        "fx_executions",
        "fx_results",
    )
    o["dispatchable"] = _sql(
        """SELECT task_id, task_type, webhook_url FROM fx_tasks WHERE webhook_url IS NOT NULL OR task_type IN (
  SELECT 'type' || cast(user_id % 5 AS string) FROM events WHERE event_type = 'view' AND event_id % 50 <> 7)""",
        "fx_tasks",
    )
    o["unregistered"] = _sql(
        """SELECT task_id, task_type, webhook_url FROM fx_tasks WHERE webhook_url IS NULL AND task_type NOT IN (
  SELECT 'type' || cast(user_id % 5 AS string) FROM events WHERE event_type = 'view' AND event_id % 50 <> 7)""",
        "fx_tasks",
    )
    o["drop_active_payloads"] = """WITH keyed AS (
  SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN sha256(cast(length(source) AS string) || ':' || source || text) END AS k FROM documents)
SELECT cast(doc_id AS string) AS task_id, doc_id AS seq, k AS payload_hash FROM keyed a
WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM keyed b WHERE b.k = a.k AND b.doc_id % 3 = 0)"""
    o["delete_tasks"] = _sql(
        f"""SELECT task_id, task_type, epoch_us(execute_at) AS execute_at, epoch_us(TIMESTAMP '{TASK_AS_OF}') AS deleted_at
FROM fx_tasks WHERE in_flight AND deleted_at IS NULL""",
        "fx_tasks",
    )
    o["upsert_tasks"] = _sql(
        f"""SELECT seq, {LOG} FROM moved WHERE deleted_at IS NULL AND seq IN (SELECT max(seq) FROM moved GROUP BY task_id)""",
        "fx_task_log",
        steps="moved AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN seq + 1000000000 ELSE seq END AS seq) FROM fx_task_log)",
    )

    # aggregations
    o["latest_tasks"] = o["compact_task_log"]
    o["log_health"] = """SELECT count(*) FILTER (event_type <> 'purchase') AS live_lines,
  count(*) FILTER (event_type = 'purchase') AS tombstone_lines, count(*) AS appends, cast(NULL AS bigint) AS bytes,
  (count(*) FILTER (event_type = 'purchase'))::double / count(*) FILTER (event_type <> 'purchase') AS tombstone_ratio,
  count(*) >= 10000 OR count(*) FILTER (event_type = 'purchase') * 2 > count(*) FILTER (event_type <> 'purchase') AS should_compact
FROM events"""
    o["queue_depth"] = _sql("SELECT count(*) AS queue_depth FROM latest", "fx_task_log", steps=LATEST)
    o["queue_stats"] = _sql("SELECT * FROM stats", *STATS_VIEWS, steps=f"{RESULTS_AS_MESSAGES}, {STATS}")
    o["active_payload_keys"] = _sql(
        "SELECT payload_hash FROM latest WHERE payload_hash IS NOT NULL GROUP BY payload_hash", "fx_task_log", steps=LATEST
    )
    o["attempt_summary"] = _sql(
        """SELECT s.task_id, s.attempts, s.attempts - CASE WHEN s.won THEN 1 ELSE 0 END AS failures, e.error_msg AS last_error,
  CASE WHEN s.won THEN 'succeeded' WHEN s.attempts >= s.allowed THEN 'dead' ELSE 'pending' END AS outcome
FROM (
  SELECT t.task_id, greatest(t.max_retries, 1) AS allowed, CASE WHEN a.n IS NULL THEN 0 ELSE least(a.first_ok, a.n, greatest(t.max_retries, 1)) END AS attempts,
         coalesce(a.first_ok <= greatest(t.max_retries, 1), false) AS won
  FROM fx_tasks t LEFT JOIN (SELECT task_id, min(no) FILTER (ok) AS first_ok, count(*) AS n FROM numbered GROUP BY task_id) a
    ON a.task_id = t.task_id) s
LEFT JOIN numbered e ON e.task_id = s.task_id AND e.no = s.attempts - CASE WHEN s.won THEN 1 ELSE 0 END""",
        "fx_tasks",
        "fx_attempts",
        steps=FIRST,
    )
    o["assemble_progress"] = _sql(
        """SELECT task_id, part, count(*) AS chunks, string_agg(data, '' ORDER BY seq) AS text
FROM (SELECT *, (row_number() OVER (PARTITION BY task_id ORDER BY seq) - 1) // 3 AS part FROM fx_progress) GROUP BY task_id, part""",
        "fx_progress",
    )
    o["read_progress"] = """SELECT cast(user_id AS string) AS task_id, count(*) AS chunks,
  string_agg('c' || cast(event_id AS string), '' ORDER BY event_id) AS text
FROM events WHERE event_type = 'click' AND event_id % 50 <> 7 GROUP BY user_id"""
    o["read_stats"] = _sql(
        """SELECT count(*) FILTER (event_type = 'signup') AS total_enqueued, count(*) FILTER (event_type = 'purchase') AS total_executed,
  count(*) FILTER (event_type = 'error') AS total_failed, cast(0 AS bigint) AS total_dlq, (SELECT count(*) FROM latest) AS queue_depth
FROM events WHERE event_id % 50 <> 7""",
        "fx_task_log",
        steps=LATEST,
    )
    o["read_arrivals"] = """SELECT 'd' || cast(event_id AS string) AS task_data,
  CASE WHEN user_id % 2 = 0 THEN sha256('5:type' || cast(user_id % 5 AS string) || 'same') END AS payload_key,
  user_id % 2 <> 0 OR row_number() OVER (PARTITION BY user_id % 2, user_id % 5 ORDER BY event_id) = 1 AS accepted
FROM events WHERE event_type = 'signup' AND event_id % 50 <> 7"""
    o["read_upserts"] = _sql(f"SELECT {LOG} FROM latest", "fx_task_log", steps=LATEST)
    o["progress_summary"] = _sql(
        """SELECT p.task_id, p.seq_count AS chunks, q.data AS last_data
FROM (SELECT task_id, count(*) AS seq_count, max(seq) AS last FROM fx_progress GROUP BY task_id) p
JOIN fx_progress q ON q.task_id = p.task_id AND q.seq = p.last""",
        "fx_progress",
    )
    o["registered_types"] = """SELECT DISTINCT 'type' || cast(user_id % 5 AS string) AS task_type FROM events
WHERE event_type = 'view' AND event_id % 50 <> 7"""

    # windows and quotas
    o["dedupe_in_flight"] = _sql(
        """SELECT seq, epoch_us(ts) AS ts, payload_key, kind,
  payload_key IS NULL OR last_enqueue IS NULL OR last_done > last_enqueue AS accepted
FROM (
  SELECT *, max(seq) FILTER (kind = 'enqueue') OVER w AS last_enqueue, coalesce(max(seq) FILTER (kind = 'done') OVER w, -1) AS last_done
  FROM fx_payload_events
  WINDOW w AS (PARTITION BY payload_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE kind = 'enqueue'""",
        "fx_payload_events",
    )
    o["admit_quota"] = _admitted("fx_requests")
    o["admit_quota_resumed"] = o["admit_quota"]
    o["rate_window_state_resumed"] = o["rate_window_state"]
    o["dedupe_resumed"] = o["dedupe_in_flight"]
    o["admit_quota_mixed"] = _admitted("fx_requests_mixed")
    o["admit_quota_rolling"] = _sql(
        """SELECT seq, us AS ts, rate_limit_group, f.admitted FROM r JOIN f ON f.g = r.rate_limit_group AND f.rn = r.rn""",
        "fx_requests",
        steps=f"""r AS (
  SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY rate_limit_group ORDER BY ts, seq) AS rn FROM fx_requests),
f AS (
  SELECT rate_limit_group AS g, rn, CASE WHEN max_per_minute > 0 THEN [us] ELSE cast([] AS bigint[]) END AS recent,
         max_per_minute > 0 AS admitted FROM r WHERE rn = 1
  UNION ALL
  SELECT g, r.rn, CASE WHEN len(list_filter(recent, lambda x: r.us - x < {W})) < r.max_per_minute
      THEN list_append(list_filter(recent, lambda x: r.us - x < {W}), r.us) ELSE list_filter(recent, lambda x: r.us - x < {W}) END,
    len(list_filter(recent, lambda x: r.us - x < {W})) < r.max_per_minute
  FROM f JOIN r ON r.rate_limit_group = f.g AND r.rn = f.rn + 1)""",
        recursive=True,
    )
    o["rolling_rate"] = _sql(
        f"""SELECT seq, epoch_us(ts) AS ts, rate_limit_group, cast(max_per_minute AS bigint) AS max_per_minute,
  count(*) OVER (PARTITION BY rate_limit_group ORDER BY epoch_us(ts) RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS trailing
FROM fx_requests""",
        "fx_requests",
    )
    o["admit_due"] = _sql(f"SELECT {TASK}, admitted FROM ticked", "fx_tasks", steps=ADMITTED_DUE)
    o["admit_due_mixed"] = _sql(
        """SELECT task_id, task_type, urgency_score, epoch_us(execute_at) AS execute_at, rate_limit_group,
  cast(max_per_minute_mixed AS bigint) AS max_per_minute,
  coalesce(f.admitted, true) AS admitted
FROM r LEFT JOIN f ON f.g = r.rate_limit_group AND f.rn = r.rn AND r.max_per_minute_mixed IS NOT NULL""",
        "fx_tasks",
        steps=f"""{DUE}, {SAVED},
r AS (SELECT due.*, row_number() OVER (PARTITION BY rate_limit_group, max_per_minute_mixed IS NULL ORDER BY {PRIORITY}) AS rn FROM due),
f AS (
  SELECT g, cast(0 AS bigint) AS rn, used AS n, false AS admitted FROM saved
  UNION ALL
  SELECT g, r.rn, n + CASE WHEN n < r.max_per_minute_mixed THEN 1 ELSE 0 END, n < r.max_per_minute_mixed
  FROM f JOIN r ON r.rate_limit_group = f.g AND r.rn = f.rn + 1 AND r.max_per_minute_mixed IS NOT NULL)""",
        recursive=True,
    )
    o["number_attempts"] = _sql(
        f"""SELECT task_id, epoch_us(attempt_ts) AS attempt_ts, ok, error_msg, cast(k1 AS bigint) AS k1, k2, k3, k4, k5,
  no - coalesce(max(CASE WHEN restarts THEN no END) OVER w, 0) AS attempt_no,
  no - coalesce(max(CASE WHEN restarts THEN no END) OVER w, 0) - 1 AS retry_count
FROM numbered WINDOW w AS (PARTITION BY task_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
        "fx_attempts",
        steps=FIRST,
    )
    o["pace_backlog"] = _sql(
        f"""SELECT {TASK}, place AS queue_rank, CASE WHEN max_per_minute > 0 THEN (place - 1) // max_per_minute END AS slot,
  CASE WHEN max_per_minute > 0 THEN epoch_us(TIMESTAMP '{TASK_AS_OF}') + ((place - 1) // max_per_minute) * 60000000 END AS planned_time
FROM ranked WHERE rate_limit_group IS NOT NULL AND max_per_minute IS NOT NULL
UNION ALL SELECT {TASK}, NULL, 0, epoch_us(TIMESTAMP '{TASK_AS_OF}') FROM ranked WHERE rate_limit_group IS NULL OR max_per_minute IS NULL""",
        "fx_tasks",
        steps=ADMITTED_DUE,
    )

    # order
    o["priority_order"] = _sql(f"SELECT {TASK} FROM due ORDER BY {PRIORITY}", "fx_tasks", steps=DUE)
    o["dispatch_batch"] = _sql(f"SELECT {TASK} FROM due ORDER BY {PRIORITY} LIMIT 100", "fx_tasks", steps=DUE)

    # transitions and schedules
    now = f"epoch_us(TIMESTAMP '{TASK_AS_OF}')"
    o["apply_results"] = _sql(
        f"""SELECT task_id, transition,
  cast(CASE transition WHEN 'retry' THEN retry_count + 1 WHEN 'rescheduled' THEN 0 ELSE retry_count END AS bigint) AS retry_count,
  CASE WHEN transition = 'rescheduled' THEN {now} + 600000000 ELSE epoch_us(execute_at) END AS execute_at,
  CASE WHEN transition = 'retry' THEN {now} + cast(trunc(retry_after_hours * 3600.0) AS bigint) * 1000000
       ELSE epoch_us(retry_after_time) END AS retry_after_time,
  CASE WHEN transition IN ('completed', 'dead') THEN {now} ELSE epoch_us(deleted_at) END AS deleted_at,
  CASE transition WHEN 'retry' THEN error_msg WHEN 'rescheduled' THEN NULL ELSE last_error_obj END AS last_error_obj,
  CASE transition WHEN 'retry' THEN error_msg WHEN 'rescheduled' THEN NULL ELSE last_error_obj END AS job_error
FROM (SELECT t.*, f.error_msg, CASE WHEN f.ok AND t.cron = '10m' THEN 'rescheduled' WHEN f.ok THEN 'completed'
        WHEN t.max_retries - t.retry_count > 1 THEN 'retry' ELSE 'dead' END AS transition
      FROM fx_tasks t JOIN firsts f ON f.task_id = t.task_id WHERE t.deleted_at IS NULL)""",
        "fx_tasks",
        "fx_attempts",
        steps=FIRST,
    )
    o["apply_attempts"] = _sql(
        """SELECT task_id, transition, attempts, cast(retries AS bigint) AS retry_count, execute_at, retry_after_time,
  CASE WHEN transition IN ('completed', 'dead') THEN moment END AS deleted_at, last_error_obj, last_error_obj AS job_error
FROM walk WHERE attempts > 0 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempts DESC) = 1""",
        "fx_tasks",
        "fx_attempts",
        recursive=True,
        steps=f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {ORDER}) AS no FROM fx_attempts),
walk AS (
  SELECT task_id, max_retries, cron, cast(trunc(retry_after_hours * 3600.0) AS bigint) * 1000000 AS delay,
         0::bigint AS attempts, 'start' AS transition, retry_count::bigint AS retries, epoch_us(execute_at) AS execute_at,
         epoch_us(retry_after_time) AS retry_after_time, 0::bigint AS moment, last_error_obj
  FROM fx_tasks WHERE deleted_at IS NULL
  UNION ALL
  SELECT task_id, max_retries, cron, delay, attempts + 1, kind,
         CASE kind WHEN 'retry' THEN retries + 1 WHEN 'rescheduled' THEN 0 ELSE retries END,
         CASE kind WHEN 'rescheduled' THEN now + 600000000 ELSE execute_at END,
         CASE kind WHEN 'retry' THEN now + delay ELSE retry_after_time END, now,
         CASE kind WHEN 'retry' THEN error_msg WHEN 'rescheduled' THEN NULL ELSE last_error_obj END
  FROM (SELECT w.*, n.error_msg, epoch_us(n.attempt_ts) AS now,
               CASE WHEN n.ok AND w.cron = '10m' THEN 'rescheduled' WHEN n.ok THEN 'completed'
                    WHEN w.retries < w.max_retries - 1 THEN 'retry' ELSE 'dead' END AS kind
        FROM walk w JOIN numbered n ON n.task_id = w.task_id AND n.no = w.attempts + 1
        WHERE w.transition NOT IN ('completed', 'dead')))""",
    )
    o["reschedule_cron"] = _sql(
        f"""SELECT t.task_id, CASE WHEN cron = '10m' THEN {now} + 600000000 ELSE epoch_us(execute_at) END AS execute_at,
  epoch_us(retry_after_time) AS retry_after_time, cast(CASE WHEN cron = '10m' THEN 0 ELSE retry_count END AS bigint) AS retry_count,
  CASE WHEN cron = '10m' THEN epoch_us(deleted_at) ELSE {now} END AS deleted_at,
  CASE WHEN cron = '10m' THEN NULL ELSE last_error_obj END AS last_error_obj
FROM fx_tasks t JOIN firsts f ON f.task_id = t.task_id WHERE f.ok AND t.deleted_at IS NULL""",
        "fx_tasks",
        "fx_attempts",
        steps=FIRST,
    )
    o["defer_denied"] = _sql(
        f"""SELECT task_id, cast(retry_count AS bigint) AS retry_count, {now} + 60000000 AS retry_after_time
FROM ticked WHERE NOT admitted""",
        "fx_tasks",
        steps=ADMITTED_DUE,
    )
    o["dead_letters"] = _sql("SELECT * FROM dead", "fx_tasks", "fx_attempts", steps=DEAD)
    o["cron_expand"] = f"""SELECT s_suppkey AS schedule_id, epoch_us(t) AS tick
FROM supplier, (SELECT unnest(generate_series(TIMESTAMP '{TICKS_FROM}', TIMESTAMP '{TICKS_TO}' - INTERVAL 1 SECOND, INTERVAL 30 SECOND)) AS t)
WHERE {TICK_RULE}"""
    o["cron_next"] = f"""SELECT s_suppkey AS schedule_id, min(epoch_us(t)) AS next_tick
FROM supplier, (SELECT unnest(generate_series(TIMESTAMP '{EVENT_AS_OF}' + INTERVAL 30 SECOND, TIMESTAMP '{EVENT_AS_OF}' + INTERVAL 2 DAY, INTERVAL 30 SECOND)) AS t)
WHERE {TICK_RULE} GROUP BY s_suppkey"""

    # handlers
    handled = "webhook_url IS NULL AND task_type IN ('type0', 'type1', 'type2', 'type3', 'type4')"
    o["run_handlers"] = _sql(
        f"""SELECT task_id, cast(task_id AS bigint) % 3 <> 0 AS ok,
  CASE WHEN cast(task_id AS bigint) % 3 = 0 THEN 'refused ' || task_id END AS error FROM due WHERE {handled}""",
        "fx_tasks",
        steps=DUE,
    )
    o["run_max_retry_handlers"] = _sql(
        f"SELECT task_id FROM dead WHERE {handled}", "fx_tasks", "fx_attempts", steps=DEAD
    )

    # streaming
    o["stream_messages"] = f"SELECT action, task_id, task_type, task_data, data, status, error FROM ({o['read_messages']})"
    o["stream_due"] = o["admit_due"]
    o["stream_latest"] = o["latest_tasks"]
    o["stream_dedupe"] = o["dedupe_in_flight"]
    o["stream_quota"] = o["admit_quota"]
    # Limits still running at the last event are not reported yet.
    o["stream_timeouts"] = _sql(
        f"""SELECT 'matched' AS kind, task_id, exec_id, result_id, status,
  CASE WHEN status <> 'success' THEN coalesce(error_msg, 'Unknown error') END AS error FROM matched
UNION ALL SELECT 'orphan', task_id, NULL, result_id, status, 'Received result for unknown/expired task_id ' || task_id
FROM fx_results WHERE result_id NOT IN (SELECT result_id FROM matched)
UNION ALL SELECT 'timeout', task_id, exec_id, NULL, NULL, error FROM late
WHERE deadline < (SELECT epoch_us(max(ts)) FROM (
  SELECT exec_ts AS ts FROM fx_executions UNION ALL SELECT result_ts FROM fx_results))""",
        "fx_executions",
        "fx_results",
        steps=pairs + ",\nlate AS (" + LATE + ")",
    )
    o["stream_orphans"] = _sql(
        """SELECT result_id, task_id, status, 'Received result for unknown/expired task_id ' || task_id AS message
FROM fx_results WHERE result_id NOT IN (SELECT result_id FROM matched)""",
        "fx_executions",
        "fx_results",
        steps=pairs,
    )
    o["stream_progress"] = """SELECT event_id AS seq, epoch_us(ts) AS event_ts, cast(user_id AS string) AS task_id,
  'c' || cast(event_id AS string) AS data FROM events WHERE event_type = 'click' AND event_id % 50 <> 7"""
    o["stream_stats"] = """SELECT count(*) FILTER (event_type = 'signup') AS total_enqueued,
  count(*) FILTER (event_type = 'purchase') AS results_ok, count(*) FILTER (event_type = 'error') AS results_failed,
  count(*) FILTER (event_type = 'click') AS progress_messages, count(*) FILTER (event_type = 'view') AS registrations
FROM events WHERE event_id % 50 <> 7"""
    return o

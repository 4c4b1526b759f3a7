"""Job-shaped views of the given tables, in SQL that Spark and DuckDB both run.

``{events}`` and the like stand for the table: a view name in DuckDB, a Parquet
path in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["events", "orders", "lineitem", "documents", "conversations", "supplier"]

TASK_AS_OF = "1998-01-01 00:00:00"
EVENT_AS_OF = "2024-01-31 09:07:30"
TICKS_FROM, TICKS_TO = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
QUOTA_WINDOW = 3600

VIEWS = {
    # Task versions; 'purchase' is a tombstone, 'error' a retry.
    "fx_task_log": """
SELECT event_id AS seq, ts AS event_ts, cast(user_id AS string) AS task_id,
       concat('type', cast(user_id % 5 AS string)) AS task_type, props AS task_data,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS retry_count, 3 AS max_retries,
       0.5e0 AS retry_after_hours, ts AS retry_after_time, ts AS execute_at,
       CASE WHEN event_type <> 'signup' THEN props END AS payload_hash,
       CASE WHEN event_type = 'purchase' THEN ts END AS deleted_at
FROM {events}""",
    # The same log as JSON lines, about one line in ten unacceptable.
    "fx_task_lines": """
SELECT event_id AS seq,
       CASE WHEN event_id % 50 = 7 THEN concat('{{"taskId":"', cast(user_id AS string), '","retryCount":')
            WHEN event_id % 50 = 8 THEN '   '
            WHEN event_id % 50 = 9 THEN concat('{{"taskId":"', cast(user_id AS string), '","retryCount":0}}')
            ELSE concat('{{"taskId":', CASE WHEN event_id % 50 = 10 THEN cast(user_id AS string)
                                           ELSE concat('"', cast(user_id AS string), '"') END,
                 ',"retryCount":', CASE WHEN event_id % 50 = 11 THEN '1.5' ELSE cast(event_id % 3 AS string) END,
                 ',"maxRetries":3,"retryAfterHours":0.5,"retryAfterTime":"2024-01-01T00:00:00Z","taskData":"d',
                 cast(event_id AS string), '","taskType":"type', cast(user_id % 5 AS string),
                 '","extra":1,"executeAt":"', CASE WHEN event_id % 50 = 12 THEN '2024-01-02'
                                                   WHEN event_id % 50 = 13 THEN '2024-01-02T02:30:00+02:00'
                                                   ELSE '2024-01-02T00:00:00.250Z' END,
                 '"', CASE WHEN event_type = 'purchase' THEN ',"deletedAt":"2024-01-03T00:00:00Z"' ELSE '' END, '}}')
       END AS value
FROM {events}""",
    # One row per job; in_flight = executing, F orders are tombstoned.
    "fx_tasks": """
SELECT cast(o_orderkey AS string) AS task_id,
       concat('type', cast(o_custkey % 7 AS string)) AS task_type,
       concat('{{"order":', cast(o_orderkey AS string), '}}') AS task_data,
       CASE WHEN o_orderpriority LIKE '4%' THEN NULL
            ELSE (6 - cast(substr(o_orderpriority, 1, 1) AS int)) / 5.0e0 END AS urgency_score,
       o_orderdate AS execute_at,
       o_orderdate + INTERVAL '1' HOUR * (o_custkey % 5) AS retry_after_time,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at,
       o_orderstatus = 'P' AS in_flight,
       cast(o_orderkey % 4 AS int) AS retry_count, cast(o_custkey % 5 AS int) AS max_retries,
       (o_custkey % 10) / 10.0e0 AS retry_after_hours,
       CASE WHEN o_orderkey % 4 > 0 THEN 'earlier error' END AS last_error_obj,
       CASE WHEN o_custkey % 6 <> 0 THEN concat('g', cast(o_custkey % 6 AS string)) END AS rate_limit_group,
       CASE WHEN o_custkey % 11 <> 0 THEN cast(5 * (o_custkey % 6) AS int) END AS max_per_minute,
       CASE WHEN o_custkey % 11 <> 0 THEN cast(o_custkey % 40 AS int) END AS max_per_minute_mixed,
       CASE WHEN o_custkey % 13 = 0 THEN 'https://hooks.example/run' END AS webhook_url,
       CASE WHEN o_custkey % 17 = 0 THEN '10m' WHEN o_custkey % 19 = 0 THEN '0 0 31 2 *' END AS cron
FROM {orders}""",
    # Attempts; the last five columns only make the order total.
    "fx_attempts": """
SELECT cast(l_orderkey AS string) AS task_id, l_shipdate AS attempt_ts,
       l_returnflag <> 'R' AS ok,
       CASE WHEN l_returnflag = 'R' THEN concat('E', cast(l_linenumber AS string)) END AS error_msg,
       l_returnflag <> 'R' AND l_orderkey % 17 = 0 AS restarts,
       l_linenumber AS k1, l_partkey AS k2, l_suppkey AS k3, l_quantity AS k4, l_extendedprice AS k5
FROM {lineitem}""",
    "fx_executions": """
SELECT event_id AS exec_id, cast(user_id AS string) AS task_id, ts AS exec_ts,
       CASE WHEN user_id % 3 <> 0 THEN 3600 * (1 + user_id % 8) END AS max_execution_seconds,
       CASE WHEN user_id % 10 = 0 THEN 'https://hooks.example/run' END AS webhook_url
FROM {events} WHERE event_type = 'view'""",
    # Some orphaned, some repeated, some late.
    "fx_results": """
SELECT event_id AS result_id, cast(user_id AS string) AS task_id, ts AS result_ts,
       CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END AS status,
       CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN props END AS error_msg
FROM {events} WHERE event_type IN ('purchase', 'error')""",
    # Recorded outcomes of both kinds: message results and webhook answers.
    "fx_outcomes": """
SELECT event_id AS outcome_id,
       CASE WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'error' THEN 'failed'
            WHEN event_type = 'signup' THEN 'Success' END AS status,
       CASE WHEN event_type = 'error' AND user_id % 2 = 0 THEN props END AS error_msg,
       CASE WHEN event_id % 9 <> 0 THEN cast(190 + event_id % 220 AS int) END AS http_status,
       CASE WHEN event_id % 9 = 0 THEN concat('refused ', cast(user_id AS string)) END AS http_error
FROM {events}""",
    "fx_payload_events": """
SELECT event_id AS seq, ts,
       CASE WHEN user_id % 25 <> 0 THEN cast(user_id AS string) END AS payload_key,
       CASE WHEN event_type IN ('purchase', 'error') THEN 'done' ELSE 'enqueue' END AS kind
FROM {events}""",
    "fx_requests": """
SELECT event_id AS seq, ts, event_type AS rate_limit_group, 2 AS max_per_minute
FROM {events}""",
    "fx_requests_mixed": """
SELECT event_id AS seq, ts, event_type AS rate_limit_group, cast(user_id % 4 AS int) AS max_per_minute
FROM {events}""",
    # Exact payload copies.
    "fx_payloads": """
SELECT doc_id AS seq, source AS task_type, text AS task_data, doc_id % 10 <> 0 AS auto_dedupe
FROM {documents}""",
    "fx_progress": """
SELECT cast(conv_id AS string) AS task_id, turn AS seq, text AS data FROM {conversations}""",
    "fx_schedules": """
SELECT s_suppkey AS schedule_id,
       CASE s_suppkey % 6 WHEN 0 THEN '10m' WHEN 1 THEN '2h' WHEN 2 THEN '0 * * * *'
            WHEN 3 THEN '*/15 9-17 * * *' WHEN 4 THEN '1d' ELSE '30s' END AS cron
FROM {supplier}""",
    # Cron texts of every form, spelled in various ways.
    "fx_crons": """
SELECT o_orderkey AS cron_id,
       CASE o_orderkey % 10
            WHEN 0 THEN concat(cast(o_custkey AS string), 's') WHEN 1 THEN concat('+', cast(o_custkey AS string), 'm')
            WHEN 2 THEN concat(' 0', cast(o_custkey AS string), 'h ') WHEN 3 THEN concat(cast(o_custkey AS string), 'd')
            WHEN 4 THEN concat(cast(o_custkey * 4000000 AS string), 's') WHEN 5 THEN concat(cast(o_custkey AS string), ' m')
            WHEN 6 THEN concat(cast(o_custkey % 60 AS string), '  * * * *')
            WHEN 7 THEN concat('0 ', cast(o_custkey % 60 AS string), ' 9-17 * * Mon ')
            WHEN 8 THEN '0 0 0 1 1 * 2030' ELSE o_orderpriority END AS cron
FROM {orders}""",
    # Enqueue messages with every mix of execute_at and cron.
    "fx_enqueues": """
SELECT event_id AS seq, cast(user_id AS string) AS task_id,
       CASE event_id % 5 WHEN 1 THEN concat('2024-02-01T0', cast(event_id % 10 AS string), ':30:00Z')
            WHEN 2 THEN 'tomorrow' WHEN 3 THEN concat('2024-02-01T0', cast(event_id % 10 AS string), ':30:00.5+02:00') END
            AS execute_at,
       CASE WHEN event_id % 5 IN (0, 2) AND user_id % 4 = 0 THEN '10m'
            WHEN event_id % 5 IN (0, 2) AND user_id % 4 = 1 THEN '2h'
            WHEN event_id % 5 IN (0, 2) AND user_id % 4 = 2 THEN 'not a cron' END AS cron
FROM {events}""",
    # Protocol lines, about one in fifty malformed.
    "fx_messages": """
SELECT event_id AS seq, ts AS event_ts,
       CASE WHEN event_id % 50 = 7 THEN '{{"action":"enqueue","task_id":'
            WHEN event_type = 'signup' THEN concat('{{"action":"enqueue","task_id":"', cast(user_id AS string),
                 '","task_type":"type', cast(user_id % 5 AS string), '","task_data":"d', cast(event_id AS string),
                 '","max_retries":3,"retry_after_hours":0.5,"auto_dedupe":', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END,
                 '}}')
            WHEN event_type = 'click' THEN concat('{{"action":"progress","task_id":"', cast(user_id AS string),
                 '","data":"c', cast(event_id AS string), '"}}')
            WHEN event_type = 'view' THEN concat('{{"action":"register","task_type":"type', cast(user_id % 5 AS string), '"}}')
            ELSE concat('{{"action":"result","task_id":"', cast(user_id AS string), '","status":"',
                 CASE WHEN event_type = 'purchase' THEN 'success' ELSE 'failed' END, '"}}') END AS value
FROM {events}""",
}


def utc(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as UTC instants (the session runs in UTC)."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in TABLES}
    return utc(spark.sql(VIEWS[name].format(**tables)))


def duckdb_view(name: str) -> str:
    return VIEWS[name].format(**{t: t for t in TABLES}).strip()

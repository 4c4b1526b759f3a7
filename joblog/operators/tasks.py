"""Task records: construction, simple transitions and row filters."""

from __future__ import annotations

import datetime as dt
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblog.functions.cron import next_tick_column, normalize_cron
from joblog.functions.payload import payload_key
from joblog.functions.rfc3339 import parse_rfc3339
from joblog.schema import INBOUND_OPTIONAL, INBOUND_REQUIRED, JOB_ERROR, TASK_COLUMNS, TASK_SCHEMA

MAX_MICROS = 2**63 - 1

# Standard reasons of HTTP statuses, as the answer text shows them.
HTTP_REASONS = {
    100: "Continue", 101: "Switching Protocols", 102: "Processing",
    200: "OK", 201: "Created", 202: "Accepted", 203: "Non Authoritative Information", 204: "No Content",
    205: "Reset Content", 206: "Partial Content", 207: "Multi-Status", 208: "Already Reported", 226: "IM Used",
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified",
    305: "Use Proxy", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found",
    405: "Method Not Allowed", 406: "Not Acceptable", 407: "Proxy Authentication Required", 408: "Request Timeout",
    409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed", 413: "Payload Too Large",
    414: "URI Too Long", 415: "Unsupported Media Type", 416: "Range Not Satisfiable", 417: "Expectation Failed",
    418: "I'm a teapot", 421: "Misdirected Request", 422: "Unprocessable Entity", 423: "Locked",
    424: "Failed Dependency", 426: "Upgrade Required", 428: "Precondition Required", 429: "Too Many Requests",
    431: "Request Header Fields Too Large", 451: "Unavailable For Legal Reasons",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable",
    504: "Gateway Timeout", 505: "HTTP Version Not Supported", 506: "Variant Also Negotiates",
    507: "Insufficient Storage", 508: "Loop Detected", 510: "Not Extended", 511: "Network Authentication Required",
}
UNKNOWN_REASON = "<unknown status code>"


def instant(as_of: str | dt.datetime | Column) -> Column:
    """``as_of`` as a UTC timestamp column; text is ``YYYY-MM-DD HH:MM:SS[.ffffff]``."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, dt.datetime):
        if as_of.tzinfo:
            as_of = as_of.astimezone(dt.timezone.utc).replace(tzinfo=None)
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp")


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("bigint") * 1_000_000)


def resolve_execute_at(df: DataFrame, as_of) -> DataFrame:
    """Set ``execute_at`` (timestamp) from the text ``execute_at`` and ``cron``.

    Text present: its time, or ``as_of`` when it is not RFC 3339 - the cron is
    then not looked at. Otherwise the first tick after ``as_of``, or ``as_of``.
    """
    now = instant(as_of)
    first_tick = next_tick_column(F.when(F.col("execute_at").isNull(), normalize_cron(F.col("cron"))), now)
    return df.withColumn(
        "execute_at",
        F.when(F.col("execute_at").isNotNull(), F.coalesce(parse_rfc3339(F.col("execute_at")), now)).otherwise(
            F.coalesce(first_tick, now)
        ),
    )


def build_tasks(enqueues: DataFrame, as_of, compat_keys: bool = False) -> DataFrame:
    """Enqueue messages to fresh task rows (all task columns, then any others)."""
    now = instant(as_of)
    dedupe = payload_key(F.col("task_type"), F.col("task_data"), F.col("auto_dedupe"), compat_keys)
    built = resolve_execute_at(enqueues, as_of).withColumns(
        {
            "cron_expression": normalize_cron(F.col("cron")),
            "retry_count": F.lit(0),
            "retry_after_time": now,
            "payload_hash": dedupe,
            "last_error_obj": F.lit(None).cast("string"),
            "last_job_error": F.lit(None).cast(JOB_ERROR),
            "deleted_at": F.lit(None).cast("timestamp"),
        }
    )
    extra = [c for c in enqueues.columns if c not in TASK_COLUMNS and c not in ("cron", "action")]
    return built.select(*[F.col(f.name).cast(f.dataType) for f in TASK_SCHEMA.fields], *extra)


def _retry_delay(hours: Column) -> Column:
    """Whole seconds of a delay in hours, cut toward zero and kept inside BIGINT."""
    seconds = hours * 3600.0
    return (
        F.when(seconds.isNull() | F.isnan(seconds), F.lit(0).cast("bigint"))
        .when(seconds >= 9.2e12, F.lit(9_200_000_000_000))
        .when(seconds <= -9.2e12, F.lit(-9_200_000_000_000))
        .otherwise(F.least(F.greatest(seconds, F.lit(-9.2e12)), F.lit(9.2e12)).cast("bigint"))
    )


def retry_columns(error: Column, as_of) -> dict[str, Column]:
    """Columns of the version that waits for its next attempt."""
    return {
        "retry_count": F.col("retry_count") + 1,
        "retry_after_time": plus_seconds(instant(as_of), _retry_delay(F.col("retry_after_hours"))),
        "last_error_obj": error,
        "last_job_error": F.when(
            error.isNotNull(), F.struct(error.alias("error"), F.lit(True).alias("retry_worthy"))
        ),
    }


def next_retry(df: DataFrame, error: str | Column, as_of) -> DataFrame:
    """Count the attempt, plan the next one, record the error (column name or column)."""
    return df.withColumns(retry_columns(F.col(error) if isinstance(error, str) else error, as_of))


def tombstone(df: DataFrame, as_of) -> DataFrame:
    return df.withColumn("deleted_at", instant(as_of))


def classify_outcomes(df: DataFrame) -> DataFrame:
    """Add ``ok`` and ``error`` to recorded outcomes.

    Rows with a ``status`` are message results. Other rows are webhook
    responses: ``http_status`` (number), ``http_error``, and ``http_reason``
    where it differs from the status's standard reason.
    """

    def optional(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)

    status, code = optional("status", "string"), optional("http_status", "int")
    standard = F.try_element_at(F.create_map(*map(F.lit, chain(*HTTP_REASONS.items()))), code)
    reason = F.coalesce(optional("http_reason", "string"), standard, F.lit(UNKNOWN_REASON))
    answer = F.concat(code.cast("string"), F.lit(" "), reason)
    by_message = F.when(status != "success", F.coalesce(optional("error_msg", "string"), F.lit("Unknown error")))
    by_webhook = F.when(
        code.isNull(),
        F.concat(
            F.lit("Webhook request failed: "), F.coalesce(optional("http_error", "string"), F.lit("no response"))
        ),
    ).when(~code.between(200, 299), F.concat(F.lit("Webhook returned non-2xx status: "), answer))
    return df.withColumn("error", F.when(status.isNotNull(), by_message).otherwise(by_webhook)).withColumn(
        "ok", F.col("error").isNull()
    )


def live_tasks(state: DataFrame) -> DataFrame:
    return state.filter(F.col("deleted_at").isNull())


def due_tasks(state: DataFrame, as_of, in_flight: DataFrame | None = None) -> DataFrame:
    """Live rows whose times have come (both bounds inclusive), not in flight."""
    now = instant(as_of)
    due = live_tasks(state).filter((F.col("execute_at") <= now) & (F.col("retry_after_time") <= now))
    return due if in_flight is None else exclude_in_flight(due, in_flight)


def exclude_in_flight(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is neither executing nor queued.

    Ids are unique per task, so a shuffled join is balanced; Spark broadcasts
    the id side by itself when its measured size allows.
    """
    return df.join(ids.select("task_id"), "task_id", "left_anti")


def _may_retry() -> Column:
    return F.col("retry_count").cast("bigint") < F.col("max_retries").cast("bigint") - 1


def retry_eligible(df: DataFrame) -> DataFrame:
    """``max_retries`` counts all attempts, the first included."""
    return df.filter(_may_retry())


def exhausted(df: DataFrame) -> DataFrame:
    return df.filter(~_may_retry())


def quota_bound(df: DataFrame) -> DataFrame:
    """Only rows with both a group and a limit are limited."""
    return df.filter(F.col("rate_limit_group").isNotNull() & F.col("max_per_minute").isNotNull())


def get_latest_task(state: DataFrame, task_id: str) -> DataFrame:
    return state.filter(F.col("task_id") == F.lit(task_id))


def route_messages(messages: DataFrame, action: str) -> DataFrame:
    """The rows of one inbound action, with that action's fields."""
    fields = [*INBOUND_REQUIRED[action], *INBOUND_OPTIONAL[action]]
    extra = [c for c in ("seq", "event_ts") if c in messages.columns]
    return messages.filter(F.col("action") == action).select(*extra, *fields)

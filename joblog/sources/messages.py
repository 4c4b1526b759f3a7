"""Protocol messages in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblog.schema import (
    CORRUPT,
    INBOUND_OPTIONAL,
    INBOUND_REQUIRED,
    MESSAGE_SCHEMA,
    MESSAGE_TYPES,
    OUTBOUND_FIELDS,
    WEBHOOK_KEYS,
)
from joblog.sources.json_rules import compute_once, finite, not_text, parse_once, sound, with_shape
from joblog.sources.line_order import in_file_order

# Webhook events.
EXECUTE, MAX_RETRIES_REACHED = "Execute", "MaxRetriesReached"
EVENT_HEADER = "X-Job-Event"


def _fault() -> Column:
    """Text of the first fault of a parsed line, null when it is a valid message."""
    action = F.col("action")
    fault = F.when(F.col(CORRUPT).isNotNull() | ~sound(), "not a readable object").when(
        action.isNull(), "missing field action"
    )
    fault = fault.when(~action.isin(list(INBOUND_REQUIRED)), F.concat(F.lit("unknown action "), action))
    # Fields of other actions are unknown keys to this one and may hold anything.
    for name, required in INBOUND_REQUIRED.items():
        for field in required:
            fault = fault.when((action == name) & F.col(field).isNull(), f"missing field {field}")
        texts = [f for f in [*required, *INBOUND_OPTIONAL[name]] if isinstance(MESSAGE_TYPES[f], T.StringType)]
        fault = fault.when((action == name) & not_text(["action", *texts]), "invalid type")
    limit = F.col("max_execution_seconds")
    numbers = finite(F.col("retry_after_hours")) & finite(F.col("urgency_score")) & (limit.isNull() | (limit >= 0))
    return fault.when((action == "enqueue") & ~numbers, "invalid value")


def decode_messages(lines: DataFrame) -> DataFrame:
    """Messages from text lines in ``value``; other columns are kept.

    Blank lines are skipped. A bad line becomes a row with ``action`` null and
    an ``error``; good lines have ``error`` null. Works on streams too.
    """
    extra = [c for c in lines.columns if c != "value"]
    parsed = parse_once(lines.filter(F.col("value").rlike(r"\S")).select(*extra, "value"), MESSAGE_SCHEMA)
    parsed = with_shape(parsed, MESSAGE_SCHEMA, [c for c, kind in MESSAGE_TYPES.items() if isinstance(kind, T.StringType)])
    checked = compute_once(parsed, "__fault", _fault())
    good = F.col("__fault").isNull()
    return checked.select(
        *extra,
        *[F.when(good, F.col(c)).alias(c) for c in MESSAGE_TYPES],
        F.concat(F.lit("Invalid JSON: "), F.col("__fault")).alias("error"),
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of text files with ``seq``, their order, and ``event_ts``, the time of their file.

    The protocol has no time of its own; ``seq`` decides the order wherever
    lines of one file share their time.
    """
    lines = in_file_order(spark.read.text(path))
    return decode_messages(lines.select("value", "seq", F.col("file_time").alias("event_ts")))


def encode_messages(df: DataFrame, action: str) -> DataFrame:
    """Outbound JSON lines (``value``) of one action, absent options left out."""
    fields = [F.col(f) for f in OUTBOUND_FIELDS[action] if f in df.columns]
    body = F.struct(F.lit(action).alias("action"), *fields)
    return df.select(F.to_json(body, {"ignoreNullFields": "true"}).alias("value"))


def acks(messages: DataFrame) -> DataFrame:
    """The ack due for every decoded enqueue (duplicates too) and register message."""
    enqueue = F.col("action") == "enqueue"
    return messages.filter(F.col("action").isin("enqueue", "register")).select(
        F.when(enqueue, F.col("task_id")).alias("task_id"),
        F.when(enqueue, "Enqueued successfully")
        .otherwise(F.concat(F.lit("Registered handler for "), F.col("task_type")))
        .alias("message"),
    )


def webhook_outbox(df: DataFrame, event: str = EXECUTE, event_header: str = EVENT_HEADER) -> DataFrame:
    """One request row per webhook task: task_id, url, headers, body."""
    body = F.struct(*[F.col(c).alias(key) for c, key in WEBHOOK_KEYS.items()])
    return df.filter(F.col("webhook_url").isNotNull()).select(
        "task_id",
        F.col("webhook_url").alias("url"),
        F.create_map(
            F.lit("Content-Type"), F.lit("application/json"), F.lit(event_header), F.lit(event)
        ).alias("headers"),
        F.to_json(body).alias("body"),
    )

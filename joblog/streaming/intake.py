"""Continuous message intake and its stateless and counting uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblog.operators.metrics import message_counters
from joblog.sources.messages import decode_messages


def stream_messages(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Messages of the text files that keep arriving in ``path``; bad lines become error rows."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    return decode_messages(lines.select("value"))


def stream_progress(messages: DataFrame) -> DataFrame:
    """Progress messages, passed on unchanged."""
    extra = [c for c in ("seq", "event_ts") if c in messages.columns]
    return messages.filter(F.col("action") == "progress").select(*extra, "task_id", "data")


def stream_stats(messages: DataFrame) -> DataFrame:
    """Running counters; write with ``outputMode("complete")``."""
    return message_counters(messages)

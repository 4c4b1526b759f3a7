"""Saved quota windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblog.functions.rfc3339 import format_rfc3339, parse_rfc3339
from joblog.schema import RATE_WINDOWS
from joblog.sources.line_order import in_file_order
from joblog.sources.versions import current_version, write_version


def read_rate_windows(spark: SparkSession, path: str) -> DataFrame:
    """(rate_limit_group, count, window_start) of the JSON map in the first line; a map with any unreadable entry is empty."""
    first = in_file_order(spark.read.text(path)).orderBy("seq").limit(1)
    read = first.select(F.from_json("value", RATE_WINDOWS, {"mode": "PERMISSIVE"}).alias("__map"))
    entries = F.transform(
        F.map_entries("__map"),
        lambda e: F.struct(
            e["key"].alias("rate_limit_group"),
            e["value"]["count"].alias("count"),
            parse_rfc3339(e["value"]["window_start"]).alias("window_start"),
        ),
    )
    sound = F.forall("__entries", lambda e: e["count"].isNotNull() & e["window_start"].isNotNull())
    return read.select(entries.alias("__entries")).filter(sound).select(F.inline("__entries"))


def encode_rate_windows(windows: DataFrame) -> DataFrame:
    """One JSON map of all windows in one line, for exchange; the tables of ``save_rate_windows`` are for any size."""
    window = F.struct(F.col("count"), format_rfc3339(F.col("window_start")).alias("window_start"))
    entry = F.struct(F.col("rate_limit_group"), window.alias("window"))
    return windows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def save_rate_windows(windows: DataFrame, root: str) -> str:
    """Save the table as the next Parquet version of ``root``."""
    return write_version(windows.select("rate_limit_group", "count", "window_start"), root)


def load_rate_windows(spark: SparkSession, root: str) -> DataFrame:
    current = current_version(spark, root)
    if current is None:
        return spark.createDataFrame([], "rate_limit_group string, count int, window_start timestamp")
    return spark.read.parquet(current)

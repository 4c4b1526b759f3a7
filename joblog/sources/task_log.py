"""Task logs: JSON lines from outside, Parquet at rest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblog.functions.rfc3339 import format_rfc3339, parse_rfc3339
from joblog.operators.state import compact_task_log, log_health
from joblog.schema import CORRUPT, TASK_COLUMNS, TASK_LINE_SCHEMA, TASK_LOG_KEYS, TASK_REQUIRED, TASK_SCHEMA
from joblog.sources.json_rules import compute_once, finite, not_text, parse_once, sound, with_shape
from joblog.sources.line_order import in_file_order
from joblog.sources.versions import write_version

_TEXT_KEYS = [TASK_LOG_KEYS[f.name] for f in TASK_SCHEMA.fields if isinstance(f.dataType, (T.StringType, T.TimestampType))]
_TIMES = [f.name for f in TASK_SCHEMA.fields if isinstance(f.dataType, T.TimestampType)]


def _read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Text lines with their file and their place in the log."""
    lines = spark.read.text([paths] if isinstance(paths, str) else list(paths))
    return in_file_order(lines).select("value", "file_path", "file_size", "seq")


def valid_log_rows(lines: DataFrame) -> DataFrame:
    """Task rows of the acceptable lines in ``value``; every other line is dropped.

    Acceptable: not blank, one JSON object of the record's types, all required
    fields present, timestamps RFC 3339, no negative time limit. Unknown keys
    are ignored. Columns other than ``value`` are kept.
    """
    extra = [c for c in lines.columns if c != "value"]
    # Kept columns travel in one struct, out of the way of the record's keys.
    kept = F.struct(*extra) if extra else F.lit(None)
    written = lines.filter(F.col("value").rlike(r"\S")).select("value", kept.alias("__kept"))
    parsed = with_shape(parse_once(written, TASK_LINE_SCHEMA), TASK_LINE_SCHEMA, _TEXT_KEYS)
    key = {c: F.col(k) for c, k in TASK_LOG_KEYS.items()}
    times = {c: parse_rfc3339(key[c]) for c in _TIMES}
    error = key["last_job_error"]
    fit = (
        F.col(CORRUPT).isNull()
        & sound()
        & (error.isNull() | (error["error"].isNotNull() & error["retry_worthy"].isNotNull()))
        & finite(key["retry_after_hours"])
        & finite(key["urgency_score"])
        & (key["max_execution_seconds"].isNull() | (key["max_execution_seconds"] >= 0))
    )
    for column in TASK_REQUIRED:
        fit = fit & key[column].isNotNull()
    fit = fit & ~not_text(_TEXT_KEYS)
    for column in times:
        fit = fit & (key[column].isNull() | F.col("__times")[column].isNotNull())
    parsed = compute_once(parsed, "__times", F.struct(*[v.alias(c) for c, v in times.items()]))
    columns = [(F.col("__times")[c] if c in times else key[c]).alias(c) for c in TASK_COLUMNS]
    return parsed.filter(fit).select(*columns, *[F.col("__kept")[c].alias(c) for c in extra])


def read_task_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Task versions of a JSON-lines log, with ``seq``, ``file_path`` and ``file_size``.

    The log's order is defined inside one file and by file name across files.
    """
    return valid_log_rows(_read_lines(spark, paths))


def encode_task_lines(df: DataFrame) -> DataFrame:
    """One JSON line (``value``) per task version, absent options left out."""
    fields = [
        (format_rfc3339(F.col(c)) if c in _TIMES else F.col(c)).alias(key)
        for c, key in TASK_LOG_KEYS.items()
        if c in df.columns
    ]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("value"))


def append_task_log(df: DataFrame, path: str, batch_id: int | None = None, fmt: str = "parquet") -> None:
    """Append task versions to a log (``parquet``, or ``json`` lines).

    With a ``batch_id`` the rows get a directory of that batch, which a replayed
    batch overwrites, so streaming appends happen once.
    """
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unknown log format {fmt!r}")
    out = df if fmt == "parquet" else encode_task_lines(df)
    target = path if batch_id is None else f"{path}/batch_id={batch_id}"
    writer = out.write.mode("append" if batch_id is None else "overwrite")
    writer.parquet(target) if fmt == "parquet" else writer.text(target)


def compact_log(log: DataFrame, root: str, only_if_due: bool = False) -> str | None:
    """Write the compacted log as a new version of ``root``; returns its path."""
    if only_if_due and not log_health(log).first()["should_compact"]:
        return None
    return write_version(compact_task_log(log), root)


def union_task_logs(logs: Mapping[str, DataFrame]) -> DataFrame:
    """Several servers' logs as one; ids are only unique per ``source``.

    Pass ``keys=("source", "task_id")`` to the state operators.
    """
    union = None
    for source, log in logs.items():
        tagged = log.withColumn("source", F.lit(source))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    if union is None:
        raise ValueError("no logs given")
    return union

"""Versioned Parquet directories: write next to the old version, then become current.

A version counts once its ``_SUCCESS`` marker is there, so a reader never sees a
half-written one and the directory being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "version="


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath, jvm.org.apache.hadoop.fs.Path


def list_dirs(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Names of the complete directories below ``root`` that start with ``prefix``, sorted."""
    fs, path, jpath = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return sorted(n for n in names if n.startswith(prefix) and fs.exists(jpath(f"{root}/{n}/_SUCCESS")))


def remove_dir(spark: SparkSession, path: str) -> None:
    fs, jpath, _ = _fs(spark, path)
    fs.delete(jpath, True)


def modified_at(spark: SparkSession, path: str) -> int:
    """Milliseconds since 1970 when a directory was finished."""
    fs, _, make = _fs(spark, path)
    return fs.getFileStatus(make(f"{path}/_SUCCESS")).getModificationTime()


def current_version(spark: SparkSession, root: str) -> str | None:
    names = list_dirs(spark, root, _PREFIX)
    return f"{root}/{names[-1]}" if names else None


def write_version(df: DataFrame, root: str) -> str:
    """Write ``df`` as the next version of ``root`` and return its path."""
    current = current_version(df.sparkSession, root)
    number = int(current.rsplit("=", 1)[1]) + 1 if current else 1
    path = f"{root}/{_PREFIX}{number:012d}"
    df.write.mode("overwrite").parquet(path)
    return path

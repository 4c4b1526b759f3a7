"""The place of a text line in its files, as one number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of ``seq`` for the place in a file; files beyond 64 TiB don't fit.
PLACE_BITS = 47
# Bits in which ``monotonically_increasing_id`` counts the rows of a task.
TASK_BITS = 33


def in_file_order(lines: DataFrame) -> DataFrame:
    """``lines`` of a text scan with ``file_path``, ``file_size``, ``file_time`` and ``seq``, a BIGINT.

    ``seq`` rises with the file's name and, inside a file, with the line; it has
    gaps. A scan promises no order, but splits of a file start a whole split
    apart, and a task's rows are no more than its bytes: so twice the split's
    start plus the row's number in the task rises along the file, also when
    splits are packed with others. The list of files, which planning the scan
    has on the driver anyway, gives the files' numbers.
    """
    spark = lines.sparkSession
    files = spark.createDataFrame([(f, i) for i, f in enumerate(sorted(lines.inputFiles()))], "__name string, __file bigint")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    placed = lines.select(
        *lines.columns,
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.input_file_name().alias("__name"),  # spelled like the list
        (2 * F.col("_metadata.file_block_start") + row).alias("__place"),
    )
    seq = F.shiftleft(F.col("__file"), PLACE_BITS) + F.col("__place")
    return placed.join(files, "__name").withColumn("seq", seq).drop("__name", "__file", "__place")

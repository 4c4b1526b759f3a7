"""Recurring schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.functions.cron import cron_fields, next_tick_column
from joblog.operators.tasks import instant
from joblog.schema import JOB_ERROR


def cron_next(df: DataFrame, as_of, expression: str = "cron_expression") -> DataFrame:
    """Add ``next_tick``: the first tick strictly after ``as_of`` (value or column), null if none."""
    return df.withColumn("next_tick", next_tick_column(F.col(expression), instant(as_of)))


def cron_expand(schedules: DataFrame, start, end, expression: str = "cron_expression") -> DataFrame:
    """One row per tick of each schedule in ``[start, end)``.

    Only the days that match are expanded further. They are spread over tasks
    first, since a handful of schedules can hold most ticks; an explicit number
    of partitions keeps adaptive execution from merging the small day rows back
    into one task.
    """
    tasks = int(schedules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, past = instant(start), instant(end)
    names = schedules.columns
    fields = F.col("__fields")
    days = (
        schedules.withColumn("__fields", cron_fields(F.col(expression)))
        .filter(fields["seconds"].isNotNull() & (first < past))
        .withColumn(
            "__day",
            F.explode(F.sequence(F.to_date(first), F.to_date(F.timestamp_micros(F.unix_micros(past) - 1)))),
        )
        .filter(
            F.array_contains(fields["months"], F.month("__day"))
            & F.array_contains(fields["days"], F.dayofmonth("__day"))
            & F.array_contains(fields["weekdays"], F.dayofweek("__day"))
            & F.array_contains(fields["years"], F.year("__day"))
        )
        .select(
            *names,
            "__day",
            fields["hours"].alias("__hours"),
            fields["minutes"].alias("__minutes"),
            fields["seconds"].alias("__seconds"),
        )
    )
    return (
        days.repartition(tasks, *names, "__day")
        .withColumn("__hour", F.explode("__hours"))
        .withColumn("__minute", F.explode("__minutes"))
        .withColumn("__second", F.explode("__seconds"))
        .withColumn(
            "tick",
            F.timestamp_seconds(
                F.unix_date("__day").cast("bigint") * 86_400
                + F.col("__hour") * 3_600
                + F.col("__minute") * 60
                + F.col("__second")
            ),
        )
        .filter((F.col("tick") >= first) & (F.col("tick") < past))
        .select(*names, "tick")
    )


def reschedule_columns(next_tick) -> dict:
    """Columns of the version that waits for its next tick; ``retry_after_time`` is kept."""
    return {
        "execute_at": next_tick,
        "retry_count": F.lit(0),
        "last_error_obj": F.lit(None).cast("string"),
        "last_job_error": F.lit(None).cast(JOB_ERROR),
    }


def reschedule_cron(tasks: DataFrame, as_of) -> DataFrame:
    """Next version of tasks that succeeded.

    A task with a coming tick waits for it, with its errors and count cleared;
    any other task is done and gets its tombstone.
    """
    again = F.col("next_tick").isNotNull()
    planned = cron_next(tasks, as_of)
    waiting = reschedule_columns(F.col("next_tick"))
    columns = {c: F.when(again, v).otherwise(F.col(c)) for c, v in waiting.items() if c in tasks.columns}
    return planned.withColumns(
        {**columns, "deleted_at": F.when(again, F.col("deleted_at")).otherwise(instant(as_of))}
    ).drop("next_tick")

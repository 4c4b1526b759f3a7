"""Queue counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblog.operators.outcomes import match_results
from joblog.operators.tasks import live_tasks


def message_counters(messages: DataFrame) -> DataFrame:
    """Running counters that one message decides alone; also usable on a stream."""
    action = F.col("action")
    return messages.agg(
        F.count_if(action == "enqueue").alias("total_enqueued"),
        F.count_if((action == "result") & (F.col("status") == "success")).alias("results_ok"),
        F.count_if((action == "result") & (F.col("status") != "success")).alias("results_failed"),
        F.count_if(action == "progress").alias("progress_messages"),
        F.count_if(action == "register").alias("registrations"),
    )


def queue_stats(
    messages: DataFrame,
    tasks: DataFrame,
    executions: DataFrame | None = None,
    dead: DataFrame | None = None,
) -> DataFrame:
    """One row of totals: enqueued, executed, failed, dead letters, depth, uptime.

    Duplicates count as enqueued. Executed and failed count results that found a
    pending execution, so a timeout is in neither; without ``executions`` every
    result counts. Webhook outcomes are not messages and are in no counter.
    Uptime is the observed span of ``event_ts`` in whole seconds. All inputs are
    reduced in one global aggregation of tagged rows.
    """
    results = messages.filter(F.col("action") == "result").select(
        F.col("seq").alias("result_id"), "task_id", F.col("event_ts").alias("result_ts"), "status"
    )
    if executions is not None:
        results = match_results(executions, results)

    def tagged(df: DataFrame, tag, ts=None) -> DataFrame:
        return df.select(tag.alias("__tag"), (ts if ts is not None else F.lit(None).cast("timestamp")).alias("__ts"))

    enqueue = F.when(F.col("action") == "enqueue", "enqueued")
    rows = tagged(messages, enqueue, F.col("event_ts"))
    rows = rows.unionByName(tagged(results, F.when(F.col("status") == "success", "executed").otherwise("failed")))
    rows = rows.unionByName(tagged(live_tasks(tasks), F.lit("depth")))
    if dead is not None:
        # Notices that go to a webhook are not counted.
        notices = dead.filter(F.col("webhook_url").isNull()) if "webhook_url" in dead.columns else dead
        rows = rows.unionByName(tagged(notices, F.lit("dlq")))

    def total(tag: str, name: str):
        return F.count_if(F.col("__tag") == tag).alias(name)

    span = F.call_function("div", F.unix_micros(F.max("__ts")) - F.unix_micros(F.min("__ts")), F.lit(1_000_000))
    return rows.agg(
        total("enqueued", "total_enqueued"),
        total("executed", "total_executed"),
        total("failed", "total_failed"),
        total("dlq", "total_dlq"),
        total("depth", "queue_depth"),
        F.coalesce(span, F.lit(0)).alias("uptime_secs"),
    )

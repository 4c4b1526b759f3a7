"""Executions, their results, and what follows for the task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblog.functions.cron import next_tick_column
from joblog.operators.schedule import reschedule_columns
from joblog.operators.tasks import exhausted, instant, live_tasks, retry_columns
from joblog.plans.ordered import (
    CARRY,
    CHUNK,
    HOT,
    HOT_ROWS,
    SEQ_CHUNK,
    TIME_CHUNK_SECONDS,
    cut,
    hot_keys,
    number_rows,
    previous_row,
    seq_chunk,
    stack,
    time_chunk,
)


def _limit(executions: DataFrame) -> Column:
    """Time limit that applies: webhook calls have none."""
    limit = F.col("max_execution_seconds")
    return F.when(F.col("webhook_url").isNull(), limit) if "webhook_url" in executions.columns else limit


def deadline_micros(executions: DataFrame) -> Column:
    """Microsecond at which an execution's limit ends, null when it has none."""
    # Beyond 100,000 years the addition would overflow; the deadline stays there.
    limit = _limit(executions)
    seconds = F.when(limit.isNotNull(), F.least(limit, F.lit(4_000_000_000_000)))
    return F.unix_micros("exec_ts") + seconds * 1_000_000


def _timeline(executions: DataFrame, results: DataFrame) -> DataFrame:
    """Both inputs as one event order per task; an execution comes before a result of its instant."""
    starts = executions.select(
        "task_id",
        F.col("exec_ts").alias("__ts"),
        F.lit(0).alias("__kind"),
        F.col("exec_id").alias("__seq"),
        F.struct(
            F.col("exec_id"), F.col("exec_ts"), deadline_micros(executions).alias("deadline")
        ).alias("__execution"),
    )
    ends = results.withColumn("__result", F.struct(*results.columns)).select(
        "task_id",
        F.col("result_ts").alias("__ts"),
        F.lit(1).alias("__kind"),
        F.col("result_id").alias("__seq"),
        "__result",
    )
    return starts.unionByName(ends, allowMissingColumns=True)


def _paired(executions: DataFrame, results: DataFrame, chunk_seconds: int, hot_rows: int) -> DataFrame:
    """Each result with the event before it; ``matched`` when that is an open execution.

    A pending execution is replaced by a newer one and consumed by the first
    result, so a result finds one exactly when the event before it on its task
    is an execution - and it is in time for it.
    """
    pairs = previous_row(
        _timeline(executions, results),
        ["task_id"],
        ["__ts", "__kind", "__seq"],
        time_chunk("__ts", chunk_seconds),
        ["__execution"],
        "__before",
        hot_rows,
    ).filter("__kind = 1")
    open_still = F.coalesce(F.unix_micros("__ts") <= F.col("__before__execution.deadline"), F.lit(True))
    return pairs.select(
        "__result.*",
        F.col("__before__execution.exec_id").alias("exec_id"),
        F.col("__before__execution.exec_ts").alias("exec_ts"),
        (F.col("__before__execution").isNotNull() & open_still).alias("matched"),
    )


def match_results(
    executions: DataFrame,
    results: DataFrame,
    chunk_seconds: int = TIME_CHUNK_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Results paired with the pending execution of their id (``exec_id``, ``exec_ts``)."""
    return _paired(executions, results, chunk_seconds, hot_rows).filter("matched").drop("matched")


def orphan_results(
    executions: DataFrame,
    results: DataFrame,
    chunk_seconds: int = TIME_CHUNK_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Results with no pending execution: unknown, repeated, superseded or too late."""
    return (
        _paired(executions, results, chunk_seconds, hot_rows)
        .filter(~F.col("matched"))
        .drop("matched", "exec_id", "exec_ts")
        .withColumn("message", F.concat(F.lit("Received result for unknown/expired task_id "), F.col("task_id")))
    )


def timed_out(
    executions: DataFrame,
    results: DataFrame,
    as_of=None,
    chunk_seconds: int = TIME_CHUNK_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Executions with a limit, no webhook, and no result within the limit.

    The next result of the task is looked up by carrying it back through the
    task's order, never by pairing all executions with all results. With
    ``as_of``, only limits that have passed by then count.
    """
    events = _timeline(executions, results).withColumn(
        "__result_ts", F.when(F.col("__kind") == 1, F.unix_micros("__ts"))
    )
    keyed = cut(events, ["task_id"], time_chunk("__ts", chunk_seconds), hot_keys(events, ["task_id"], hot_rows))
    later = (
        Window.partitionBy("task_id").orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        keyed.filter(HOT)
        .groupBy("task_id", CHUNK)
        .agg(F.min("__result_ts").alias("__result_ts"))
        .select("task_id", CHUNK, F.last("__result_ts", ignorenulls=True).over(later).alias("__result_ts"))
    )
    backwards = (
        Window.partitionBy("task_id", CHUNK)
        .orderBy(F.col(CARRY).desc(), F.col("__ts").desc(), F.col("__kind").desc(), F.col("__seq").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    deadline = F.col("__execution.deadline")
    late = (
        stack(keyed, carried)
        .withColumn("__next", F.last("__result_ts", ignorenulls=True).over(backwards))
        .filter((F.col("__kind") == 0) & deadline.isNotNull())
        .filter(F.col("__next").isNull() | (F.col("__next") > deadline))
    )
    if as_of is not None:
        late = late.filter(deadline < F.unix_micros(instant(as_of)))
    seconds = F.call_function("div", deadline - F.unix_micros("__ts"), F.lit(1_000_000))
    return late.select(
        F.col("__execution.exec_id").alias("exec_id"),
        "task_id",
        F.col("__ts").alias("exec_ts"),
        F.timestamp_micros(deadline).alias("deadline"),
        F.concat(F.lit("Task execution timed out after "), seconds.cast("string"), F.lit(" seconds")).alias("error"),
    )


def registered_types(messages: DataFrame) -> DataFrame:
    """Distinct task types named in ``register`` messages."""
    return messages.filter(F.col("action") == "register").select("task_type").distinct()


def _webhook(df: DataFrame) -> Column:
    return F.col("webhook_url").isNotNull() if "webhook_url" in df.columns else F.lit(False)


def _typed(df: DataFrame, types: DataFrame) -> DataFrame:
    """Add ``__known``: the row's type is among the types.

    Spark broadcasts the types by their measured size, or else splits a
    popular type of the left side.
    """
    known = types.select("task_type").distinct().withColumn("__known", F.lit(True))
    return df.join(known, "task_type", "left").select(*df.columns, "__known")


def dispatchable(df: DataFrame, types: DataFrame) -> DataFrame:
    """Rows whose type has a handler, and webhook rows, which need none."""
    return _typed(df, types).filter(F.col("__known").isNotNull() | _webhook(df)).drop("__known")


def unregistered(df: DataFrame, types: DataFrame) -> DataFrame:
    """Rows that stay pending because nothing handles their type."""
    return _typed(df, types).filter(F.col("__known").isNull() & ~_webhook(df)).drop("__known")


def number_attempts(
    attempts: DataFrame,
    order: Sequence[str] = ("attempt_ts",),
    restarts: str | None = "restarts",
    chunk_seconds: int = TIME_CHUNK_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``attempt_no`` (from 1) and ``retry_count`` (from 0) per task.

    Counting starts again after a row whose ``restarts`` flag is set (a success
    of a recurring task). ``order`` starts with a timestamp and has to be total.
    """
    numbered = number_rows(
        attempts, ["task_id"], list(order), time_chunk(order[0], chunk_seconds), "attempt_no", restarts, hot_rows
    )
    return numbered.withColumn("retry_count", F.col("attempt_no") - 1)


def attempt_summary(
    tasks: DataFrame,
    attempts: DataFrame,
    order: Sequence[str] = ("attempt_ts",),
    chunk_seconds: int = TIME_CHUNK_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per task: attempts counted, failures before the first success, last error, outcome.

    ``succeeded`` when a success comes among the first ``max(max_retries, 1)``
    attempts, ``dead`` when all of those failed, else ``pending``. Attempts
    after either do not count, nor do attempts of unknown tasks. A task's row
    travels with its attempts as their carry row, so the attempts are shuffled
    once and there is no join; a hot task has a carry row per chunk, with the
    attempts so far and whether one of them succeeded.
    """
    order = list(order)
    rows = attempts.select("task_id", *order, "ok", "error_msg")
    hot = hot_keys(rows, ["task_id"], hot_rows)
    keyed = cut(rows, ["task_id"], time_chunk(order[0], chunk_seconds), hot)
    limits = tasks.select("task_id", "max_retries")
    earlier = Window.partitionBy("task_id").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    nothing = {"__weight": F.lit(0).cast("bigint"), "__ok": F.lit(0), CHUNK: F.lit(0).cast("bigint")}
    ordinary = limits.join(hot, "task_id", "left_anti").withColumns(nothing)
    cut_up = (
        keyed.filter(HOT)
        .groupBy("task_id", CHUNK)
        .agg(F.count(F.lit(1)).alias("__n"), F.max(F.col("ok").cast("int")).alias("__any"))
        .join(limits.join(hot, "task_id", "left_semi"), "task_id")
        .select(
            "task_id",
            "max_retries",
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__weight"),
            F.coalesce(F.max("__any").over(earlier), F.lit(0)).alias("__ok"),
            CHUNK,
        )
    )
    stacked = stack(
        keyed.withColumns({"__weight": F.lit(1).cast("bigint"), "__ok": F.col("ok").cast("int")}),
        ordinary.unionByName(cut_up),
    )
    in_order = Window.partitionBy("task_id", CHUNK).orderBy(F.col(CARRY).desc(), *order)
    to_here = in_order.rowsBetween(Window.unboundedPreceding, 0)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    allowed = F.greatest(F.col("__allowed"), F.lit(1))
    failed = ~F.col(CARRY) & ~F.col("ok")
    summary = (
        stacked.withColumns(
            {
                "__no": F.sum("__weight").over(to_here),
                "__allowed": F.first("max_retries", ignorenulls=True).over(to_here),
                "__done": F.max("__ok").over(before),
            }
        )
        .filter(F.col(CARRY) | ((F.col("__no") <= allowed) & (F.col("__done") == 0)))
        .groupBy("task_id")
        .agg(
            F.max("max_retries").alias("max_retries"),
            F.count_if(~F.col(CARRY)).alias("attempts"),
            F.count_if(failed).alias("failures"),
            F.max_by(F.when(failed, F.col("error_msg")), F.when(failed, F.col("__no"))).alias("last_error"),
            F.max(F.when(~F.col(CARRY), F.col("ok"))).alias("__won"),
        )
    )
    limit = F.greatest(F.col("max_retries"), F.lit(1))
    outcome = F.when(F.col("__won"), "succeeded").when(F.col("failures") >= limit, "dead").otherwise("pending")
    return summary.select("task_id", "attempts", "failures", "last_error", outcome.alias("outcome"))


def assemble_progress(
    progress: DataFrame,
    part_chunks: int,
    chunk_rows: int = SEQ_CHUNK,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Partial chunks of each task joined in order: (task_id, part, chunks, text).

    A part holds up to ``part_chunks`` chunks (parts count from 0), so the
    progress of a task of any length is whole, yet never one value in one task.
    The number belongs to the result, so the caller chooses it.
    """
    rows = progress.select("task_id", "seq", "data")
    numbered = number_rows(
        rows, ["task_id"], ["seq"], seq_chunk("seq", chunk_rows), "__no", hot_rows=hot_rows
    )
    chunks = F.sort_array(F.collect_list(F.struct("seq", "data")))
    return (
        numbered.withColumn("part", F.call_function("div", F.col("__no") - 1, F.lit(part_chunks)))
        .groupBy("task_id", "part")
        .agg(F.count(F.lit(1)).alias("chunks"), chunks.alias("__chunks"))
        .select(
            "task_id",
            "part",
            "chunks",
            F.array_join(F.transform("__chunks", lambda c: c["data"]), "").alias("text"),
        )
    )


def join_parts(parts: DataFrame) -> DataFrame:
    """One row (task_id, chunks, text) for each task of ``assemble_progress``, however many parts it has.

    The text of a task is one value then; take the parts where tasks have no bound.
    """
    texts = F.sort_array(F.collect_list(F.struct("part", "text")))
    return (
        parts.groupBy("task_id")
        .agg(F.sum("chunks").alias("chunks"), texts.alias("__parts"))
        .select("task_id", "chunks", F.array_join(F.transform("__parts", lambda p: p["text"]), "").alias("text"))
    )


def progress_summary(progress: DataFrame) -> DataFrame:
    """Per task: number of chunks and the last one."""
    return progress.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max_by("data", "seq").alias("last_data")
    )


def apply_results(tasks: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """Next version of each task that has an outcome (task_id, ok, error), with its ``transition``.

    completed: tombstone. rescheduled: recurring, waits for its next tick.
    retry: attempt counted, waits for its delay. dead: tombstone, error fields
    as they were. One outcome per task; both sides are unique by id. Only live
    tasks run, so tombstoned ones have no transition.
    """
    now = instant(as_of)
    joined = live_tasks(tasks).join(outcomes.select("task_id", F.col("ok").alias("__ok"), F.col("error").alias("__error")), "task_id")
    tick = next_tick_column(F.when(F.col("__ok"), F.col("cron_expression")), now)
    may_retry = F.col("retry_count").cast("bigint") < F.col("max_retries").cast("bigint") - 1
    decided = joined.withColumn("__tick", tick).withColumn(
        "transition",
        F.when(F.col("__ok") & F.col("__tick").isNotNull(), "rescheduled")
        .when(F.col("__ok"), "completed")
        .when(may_retry, "retry")
        .otherwise("dead"),
    )
    transition = F.col("transition")
    retried, waiting = retry_columns(F.col("__error"), as_of), reschedule_columns(F.col("__tick"))
    changed = {}
    for column in tasks.columns:
        value = F.col(column)
        if column in retried:
            value = F.when(transition == "retry", retried[column]).otherwise(value)
        if column in waiting:
            value = F.when(transition == "rescheduled", waiting[column]).otherwise(value)
        if column == "deleted_at":
            value = F.when(transition.isin("completed", "dead"), now).otherwise(value)
        changed[column] = value.alias(column)
    return decided.select(*changed.values(), "transition")


def apply_attempts(
    tasks: DataFrame,
    attempts: DataFrame,
    order: Sequence[str] = ("attempt_ts",),
    chunk_seconds: int = TIME_CHUNK_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Last version of each live task that has attempts (task_id, ok, error_msg), all of them taken in order.

    Adds ``transition``, that of the last attempt that counts, and ``attempts``,
    how many count. A failure is a retry while the attempts of its run are fewer
    than ``max_retries``, else the task is dead. A success starts the next run of a recurring task
    at its first tick after the attempt and completes any other. What comes
    after the end of a task does not count. ``order`` starts with the attempt's
    timestamp and has to be total; ``ok`` null is a failure.

    Up to its end a task restarts at each success, so a run is numbered by the
    attempts alone, hot tasks in chunks; the end is the first attempt that no
    rule lets pass. Everything else is minima and maxima by order, combined
    before they are shuffled.
    """
    order = list(order)
    at = F.struct(*order)
    rows = attempts.select(
        "task_id", *order, F.coalesce("ok", F.lit(False)).alias("__ok"), F.col("error_msg").alias("__error")
    )
    # The shuffled rows are narrow; what the rules need of a task joins them by its unique id.
    numbered = number_rows(rows, ["task_id"], order, time_chunk(order[0], chunk_seconds), "__no", "__ok", hot_rows)
    first_success = rows.filter("__ok").groupBy("task_id").agg(F.min(at).alias("__success"))
    facts = (
        live_tasks(tasks)
        .select(
            "task_id",
            F.col("retry_count").cast("bigint").alias("__count"),
            F.col("max_retries").cast("bigint").alias("__most"),
            F.col("cron_expression").alias("__cron"),
        )
        .join(first_success, "task_id", "left")
    )
    # The first run goes on from the task's own count.
    first_run = F.col("__success").isNull() | (at <= F.col("__success"))
    before = F.when(first_run, F.col("__count")).otherwise(F.lit(0)) + F.col("__no") - 1
    transition = (
        F.when(F.col("__ok") & F.col("__tick").isNotNull(), "rescheduled")
        .when(F.col("__ok"), "completed")
        .when(F.col("__before") < F.col("__most") - 1, "retry")
        .otherwise("dead")
    )
    moved = (
        numbered.join(facts, "task_id")
        .withColumns({"__before": before, "__tick": next_tick_column(F.when(F.col("__ok"), F.col("__cron")), F.col(order[0]))})
        .select("task_id", at.alias("__at"), F.col(order[0]).alias("__ts"), "__error", "__before", "__tick", transition.alias("transition"))
    )
    ends = moved.filter(F.col("transition").isin("completed", "dead")).groupBy("task_id").agg(F.min("__at").alias("__end"))
    counted = moved.join(ends, "task_id", "left").filter(F.col("__end").isNull() | (F.col("__at") <= F.col("__end")))
    failed, waits = F.col("transition") == "retry", F.col("transition") == "rescheduled"
    last = counted.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max(F.struct("__at", "transition", "__before", "__ts")).alias("__last"),
        F.max(F.when(failed, F.struct("__at", "__ts", "__error"))).alias("__retry"),
        F.max(F.when(waits, F.struct("__at", "__tick"))).alias("__again"),
    )
    joined = live_tasks(tasks).join(last, "task_id")
    retry, again = F.col("__retry"), F.col("__again")
    kind = F.col("__last.transition")
    erred = retry.isNotNull() & (again.isNull() | (retry["__at"] > again["__at"]))
    retried = retry_columns(retry["__error"], retry["__ts"])
    values = {
        "retry_count": F.when(kind == "rescheduled", F.lit(0)).otherwise(F.col("__last.__before") + F.when(kind == "retry", 1).otherwise(0)),
        "execute_at": F.when(again.isNotNull(), again["__tick"]).otherwise(F.col("execute_at")),
        "retry_after_time": F.when(retry.isNotNull(), retried["retry_after_time"]).otherwise(F.col("retry_after_time")),
        "deleted_at": F.when(kind.isin("completed", "dead"), F.col("__last.__ts")).otherwise(F.col("deleted_at")),
    }
    for column in ("last_error_obj", "last_job_error"):
        if column in tasks.columns:
            values[column] = F.when(erred, retried[column]).when(again.isNull(), F.col(column))
    kinds = {f.name: f.dataType for f in tasks.schema.fields}
    return joined.select(
        *[values[c].cast(kinds[c]).alias(c) if c in values else F.col(c) for c in tasks.columns],
        kind.alias("transition"),
        "attempts",
    )


def dead_letters(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Live tasks whose last allowed attempt failed: id, type, data, and where the notice goes."""
    failed = outcomes.filter(~F.col("ok")).select("task_id", "error")
    url = F.col("webhook_url") if "webhook_url" in tasks.columns else F.lit(None).cast("string")
    return (
        exhausted(live_tasks(tasks))
        .join(failed, "task_id")
        .select(
            "task_id",
            "task_type",
            "task_data",
            url.alias("webhook_url"),
            F.when(url.isNotNull(), "webhook").otherwise("message").alias("route"),
            "error",
        )
    )

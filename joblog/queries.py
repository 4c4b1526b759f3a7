"""One query per operator, over the fixture views of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblog.fixtures import EVENT_AS_OF, QUOTA_WINDOW, TASK_AS_OF, TICKS_FROM, TICKS_TO, view
from joblog.functions.cron import normalize_cron
from joblog.functions.payload import payload_key
from joblog.operators import dedupe, dispatch, handlers, metrics, outcomes, quota, schedule, state, tasks
from joblog.plans.ordered import pick_per
from joblog.session import configure, scratch_path
from joblog.sources import messages, rate_windows, task_log

# Chunks per part of assembled progress.
PART_CHUNKS = 3
# Where the resumed queries stop and start again.
HALFWAY = "2024-01-16 00:00:00"
ATTEMPT_ORDER = ("attempt_ts", "k1", "k2", "k3", "k4", "k5")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Timestamps as epoch microseconds and integers as BIGINT, to compare across engines."""

    def convert(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return F.unix_micros(column).alias(field.name)
        if isinstance(field.dataType, T.IntegerType):
            return column.cast("bigint").alias(field.name)
        return column

    return df.select(*[convert(f) for f in df.schema.fields])


class Views:
    """The fixture views of one data directory, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, f"fx_{name}")

    def in_flight(self) -> DataFrame:
        return self.tasks.filter("in_flight").select("task_id")

    def due(self) -> DataFrame:
        return tasks.due_tasks(self.tasks, TASK_AS_OF, self.in_flight())

    def decoded(self) -> DataFrame:
        return messages.decode_messages(self.messages)

    def task_rows(self) -> DataFrame:
        """fx_tasks with the columns that transitions change."""
        error = F.col("last_error_obj")
        return self.tasks.withColumn("cron_expression", normalize_cron(F.col("cron"))).withColumn(
            "last_job_error", F.when(error.isNotNull(), F.struct(error.alias("error"), F.lit(True).alias("retry_worthy")))
        )

    def first_outcomes(self) -> DataFrame:
        """The first attempt of each task as its outcome."""
        first = pick_per(self.attempts, ["task_id"], ATTEMPT_ORDER, last=False)
        return first.select("task_id", "ok", F.col("error_msg").alias("error"))


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register a query under its function's name (less ``_query``, where that hides an import)."""
    _QUERIES[fn.__name__.removesuffix("_query")] = lambda spark, sf_dir: plain(fn(Views(spark, sf_dir)))
    return fn


def queries() -> dict[str, Query]:
    import joblog.stream_queries  # noqa: F401 - registers the streaming queries

    return dict(_QUERIES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 100 due live tasks."""
    v = Views(spark, sf_dir)
    return plain(dispatch.dispatch_batch(v.due()).select("task_id", "task_type", "urgency_score", "execute_at"))


LOG_COLUMNS = [
    "task_id", "task_type", "task_data", "retry_count", "max_retries", "execute_at", "payload_hash", "deleted_at",
]
TASK_KEYS = ["task_id", "task_type", "urgency_score", "execute_at", "rate_limit_group", "max_per_minute"]


# --- sources and sinks


@query
def read_task_log(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "task-log")
    task_log.append_task_log(v.task_log, path, fmt="json")
    return task_log.read_task_log(v.spark, path).select(*LOG_COLUMNS)


@query
def valid_log_rows(v: Views) -> DataFrame:
    return task_log.valid_log_rows(v.task_lines).select("seq", *LOG_COLUMNS)


@query
def read_messages(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "messages")
    v.messages.select("value").write.text(path)
    read = messages.read_messages(v.spark, path)
    return read.select(
        "action", "task_id", "task_type", "task_data", "max_retries", "retry_after_hours", "auto_dedupe", "data",
        "status", "error",
    )


def _read_back(v: Views) -> DataFrame:
    """The messages as a reader returns them: written in order to one file, so ``seq`` is their order."""
    path = scratch_path(v.spark, "messages")
    v.messages.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(path)
    return messages.read_messages(v.spark, path)


@query
def read_progress(v: Views) -> DataFrame:
    """Progress assembled from what ``read_messages`` returned."""
    return outcomes.join_parts(outcomes.assemble_progress(tasks.route_messages(_read_back(v), "progress"), part_chunks=PART_CHUNKS))


@query
def read_stats(v: Views) -> DataFrame:
    """Counters of what ``read_messages`` returned; every result counts, and uptime is that of the files."""
    return metrics.queue_stats(_read_back(v), state.latest_tasks(v.task_log)).drop("uptime_secs")


@query
def read_arrivals(v: Views) -> DataFrame:
    """Duplicate payloads among the enqueues that ``read_messages`` returned, in line order."""
    enqueues = tasks.route_messages(_read_back(v), "enqueue")
    key = payload_key(F.col("task_type"), F.lit("same"), F.col("auto_dedupe"))
    events = enqueues.select("seq", "task_data", key.alias("payload_key"), F.lit("enqueue").alias("kind"))
    return dedupe.dedupe_in_flight(events).select("task_data", "payload_key", "accepted")


@query
def read_upserts(v: Views) -> DataFrame:
    """State from a log read back, changed by later versions of the same log."""
    path = scratch_path(v.spark, "task-log")
    ordered = v.task_log.repartitionByRange("seq").sortWithinPartitions("seq")
    task_log.append_task_log(ordered, path, fmt="json")
    log = task_log.read_task_log(v.spark, path)
    middle = log.agg(F.avg("seq")).first()[0]
    return state.upsert_tasks(state.latest_tasks(log.filter(F.col("seq") < middle)), log.filter(F.col("seq") >= middle)).select(*LOG_COLUMNS)


@query
def append_task_log(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "append")
    for batch in (0, 1, 1):  # the second batch is replayed
        task_log.append_task_log(v.task_log.filter(F.col("seq") % 2 == batch), path, batch_id=batch)
    return v.spark.read.parquet(path).select("seq", *LOG_COLUMNS)


@query
def compact_task_log(v: Views) -> DataFrame:
    path = task_log.compact_log(v.task_log, scratch_path(v.spark, "compact"))
    return v.spark.read.parquet(path).select("seq", *LOG_COLUMNS)


@query
def read_rate_windows(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "windows")
    rate_windows.encode_rate_windows(quota.rate_window_state(v.requests, QUOTA_WINDOW)).write.text(path)
    return rate_windows.read_rate_windows(v.spark, path)


def _result_rows(decoded: DataFrame) -> DataFrame:
    """The result messages as rows for pairing."""
    results = tasks.route_messages(decoded, "result")
    return results.select(F.col("seq").alias("result_id"), "task_id", F.col("event_ts").alias("result_ts"), "status", "error_msg")


@query
def encode_messages(v: Views) -> DataFrame:
    decoded = v.decoded()
    errors = decoded.filter("error is not null").select(F.col("error").alias("message"))
    orphans = outcomes.orphan_results(v.executions.filter("webhook_url is null"), _result_rows(decoded)).select("task_id", "message")
    running = outcomes.dispatchable(v.due(), outcomes.registered_types(decoded)).filter("webhook_url is null")
    executions = running.withColumn(
        "max_execution_seconds", F.when(F.col("retry_count") > 0, F.col("retry_count").cast("bigint") * 60)
    )
    letters = outcomes.dead_letters(v.tasks, v.first_outcomes())
    parts = [
        messages.encode_messages(messages.acks(decoded), "ack"),
        messages.encode_messages(tasks.route_messages(decoded, "progress"), "progress"),
        messages.encode_messages(errors, "error"),
        messages.encode_messages(orphans, "error"),
        messages.encode_messages(executions, "execute"),
        messages.encode_messages(letters.filter("route = 'message'"), "max_retries_reached"),
        messages.encode_messages(
            metrics.queue_stats(decoded, state.latest_tasks(v.task_log), v.executions.filter("webhook_url is null"), letters),
            "stats",
        ),
    ]
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


@query
def webhook_outbox(v: Views) -> DataFrame:
    out = messages.webhook_outbox(v.due(), messages.EXECUTE)
    return out.select(
        "task_id", "url", F.col("headers")["Content-Type"].alias("content_type"),
        F.col("headers")[messages.EVENT_HEADER].alias("event"), "body",
    )


@query
def union_task_logs(v: Views) -> DataFrame:
    log = v.task_log
    union = task_log.union_task_logs({"even": log.filter("seq % 2 = 0"), "odd": log.filter("seq % 2 = 1")})
    return state.latest_tasks(union, ["source", "task_id"]).select("source", "seq", *LOG_COLUMNS)


# --- projections


@query
def build_tasks(v: Views) -> DataFrame:
    built = tasks.build_tasks(tasks.route_messages(v.decoded(), "enqueue"), EVENT_AS_OF)
    return built.select(
        "seq", "task_id", "task_type", "task_data", "retry_count", "max_retries", "retry_after_hours",
        "retry_after_time", "execute_at", "payload_hash", "deleted_at",
    )


@query
def resolve_execute_at(v: Views) -> DataFrame:
    return tasks.resolve_execute_at(v.enqueues, EVENT_AS_OF)


@query
def payload_key_query(v: Views) -> DataFrame:
    key = payload_key(F.col("task_type"), F.col("task_data"), F.col("auto_dedupe"))
    compat = payload_key(F.col("task_type"), F.col("task_data"), compat=True)
    return v.payloads.select("seq", key.alias("payload_key"), compat.alias("compat_key"))


@query
def normalize_cron_query(v: Views) -> DataFrame:
    return v.crons.select("cron_id", normalize_cron(F.col("cron")).alias("cron_expression"))


@query
def next_retry(v: Views) -> DataFrame:
    retried = tasks.next_retry(v.tasks, F.when(F.col("retry_count") > 1, F.lit("again")), TASK_AS_OF)
    return retried.select(
        "task_id", "retry_count", "retry_after_time", "last_error_obj",
        F.col("last_job_error.error").alias("job_error"), F.col("last_job_error.retry_worthy").alias("retry_worthy"),
    )


@query
def tombstone(v: Views) -> DataFrame:
    return tasks.tombstone(state.latest_tasks(v.task_log), EVENT_AS_OF).select("seq", *LOG_COLUMNS)


@query
def classify_outcomes(v: Views) -> DataFrame:
    return tasks.classify_outcomes(v.outcomes).select("outcome_id", "ok", "error")


# --- filters and lookups


@query
def live_tasks(v: Views) -> DataFrame:
    return tasks.live_tasks(v.tasks).select(*TASK_KEYS)


@query
def due_tasks(v: Views) -> DataFrame:
    return v.due().select(*TASK_KEYS)


@query
def retry_eligible(v: Views) -> DataFrame:
    return tasks.retry_eligible(v.tasks).select("task_id", "retry_count", "max_retries")


@query
def exhausted(v: Views) -> DataFrame:
    return tasks.exhausted(v.tasks).select("task_id", "retry_count", "max_retries")


@query
def quota_bound(v: Views) -> DataFrame:
    return tasks.quota_bound(v.tasks).select(*TASK_KEYS)


@query
def get_latest_task(v: Views) -> DataFrame:
    return tasks.get_latest_task(state.latest_tasks(v.task_log), "8").select("seq", *LOG_COLUMNS)


@query
def route_messages(v: Views) -> DataFrame:
    decoded = v.decoded()
    parts = [
        tasks.route_messages(decoded, "enqueue").select("seq", F.lit("enqueue").alias("action"), "task_id", F.col("task_data").alias("detail")),
        tasks.route_messages(decoded, "progress").select("seq", F.lit("progress").alias("action"), "task_id", F.col("data").alias("detail")),
        tasks.route_messages(decoded, "result").select("seq", F.lit("result").alias("action"), "task_id", F.col("status").alias("detail")),
        tasks.route_messages(decoded, "register").select("seq", F.lit("register").alias("action"), F.lit(None).cast("string").alias("task_id"), F.col("task_type").alias("detail")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


# --- joins


@query
def exclude_in_flight(v: Views) -> DataFrame:
    return tasks.exclude_in_flight(v.tasks, v.in_flight()).select(*TASK_KEYS)


@query
def match_results(v: Views) -> DataFrame:
    return outcomes.match_results(v.executions, v.results)


@query
def orphan_results(v: Views) -> DataFrame:
    return outcomes.orphan_results(v.executions, v.results)


@query
def timed_out(v: Views) -> DataFrame:
    return outcomes.timed_out(v.executions, v.results)


def _types(v: Views) -> DataFrame:
    return outcomes.registered_types(v.decoded())


@query
def dispatchable(v: Views) -> DataFrame:
    return outcomes.dispatchable(v.tasks, _types(v)).select("task_id", "task_type", "webhook_url")


@query
def unregistered(v: Views) -> DataFrame:
    return outcomes.unregistered(v.tasks, _types(v)).select("task_id", "task_type", "webhook_url")


def _arrivals(v: Views) -> DataFrame:
    key = F.when(F.col("auto_dedupe"), payload_key(F.col("task_type"), F.col("task_data")))
    return v.payloads.select(F.col("seq").cast("string").alias("task_id"), "seq", key.alias("payload_hash"))


@query
def drop_active_payloads(v: Views) -> DataFrame:
    arrivals = _arrivals(v)
    active = arrivals.filter(F.col("seq") % 3 == 0).select("payload_hash").distinct()
    return dedupe.drop_active_payloads(arrivals, active)


@query
def delete_tasks(v: Views) -> DataFrame:
    ids = v.tasks.filter("in_flight").select("task_id")
    return state.delete_tasks(v.tasks, ids, TASK_AS_OF).select("task_id", "task_type", "execute_at", "deleted_at")


@query
def upsert_tasks(v: Views) -> DataFrame:
    log = v.task_log
    before = state.latest_tasks(log.filter("seq % 3 <> 0"))
    changes = log.filter("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)
    return state.upsert_tasks(before, changes).select("seq", *LOG_COLUMNS)


# --- aggregations


@query
def latest_tasks(v: Views) -> DataFrame:
    return state.latest_tasks(v.task_log).select("seq", *LOG_COLUMNS)


@query
def log_health(v: Views) -> DataFrame:
    return state.log_health(v.task_log)


@query
def queue_depth(v: Views) -> DataFrame:
    return state.queue_depth(state.latest_tasks(v.task_log))


@query
def queue_stats(v: Views) -> DataFrame:
    return metrics.queue_stats(
        v.decoded(),
        state.latest_tasks(v.task_log),
        v.executions.filter("webhook_url is null"),
        outcomes.dead_letters(v.tasks, v.first_outcomes()),
    )


@query
def active_payload_keys(v: Views) -> DataFrame:
    return state.active_payload_keys(state.latest_tasks(v.task_log))


@query
def attempt_summary(v: Views) -> DataFrame:
    return outcomes.attempt_summary(v.tasks, v.attempts, ATTEMPT_ORDER)


@query
def assemble_progress(v: Views) -> DataFrame:
    return outcomes.assemble_progress(v.progress, part_chunks=PART_CHUNKS)


@query
def progress_summary(v: Views) -> DataFrame:
    return outcomes.progress_summary(v.progress)


@query
def rate_window_state(v: Views) -> DataFrame:
    return quota.rate_window_state(v.requests, QUOTA_WINDOW)


@query
def registered_types(v: Views) -> DataFrame:
    return _types(v)


# --- windows and quotas


@query
def dedupe_in_flight(v: Views) -> DataFrame:
    return dedupe.dedupe_in_flight(v.payload_events)


@query
def admit_quota(v: Views) -> DataFrame:
    return quota.admit_quota(v.requests, QUOTA_WINDOW)


@query
def admit_quota_resumed(v: Views) -> DataFrame:
    """The requests in two runs, the second from the windows that the first leaves."""
    first, rest = (v.requests.filter(f"{test} timestamp '{HALFWAY}'") for test in ("ts <", "ts >="))
    then = quota.admit_quota(rest, QUOTA_WINDOW, windows=quota.rate_window_state(first, QUOTA_WINDOW))
    return quota.admit_quota(first, QUOTA_WINDOW).unionByName(then)


@query
def rate_window_state_resumed(v: Views) -> DataFrame:
    first, rest = (v.requests.filter(f"{test} timestamp '{HALFWAY}'") for test in ("ts <", "ts >="))
    return quota.rate_window_state(rest, QUOTA_WINDOW, windows=quota.rate_window_state(first, QUOTA_WINDOW))


@query
def dedupe_resumed(v: Views) -> DataFrame:
    """The events in two runs, the second from the keys that the first leaves active."""
    events = v.payload_events
    middle = events.agg(F.avg("seq")).first()[0]
    first, rest = events.filter(F.col("seq") < middle), events.filter(F.col("seq") >= middle)
    return dedupe.dedupe_in_flight(first).unionByName(dedupe.dedupe_in_flight(rest, dedupe.active_keys(first)))


@query
def admit_quota_mixed(v: Views) -> DataFrame:
    return quota.admit_quota(v.requests_mixed, QUOTA_WINDOW)


@query
def admit_quota_rolling(v: Views) -> DataFrame:
    return quota.admit_quota(v.requests, QUOTA_WINDOW, mode="rolling").select(
        "seq", "ts", "rate_limit_group", "admitted"
    )


@query
def rolling_rate(v: Views) -> DataFrame:
    return quota.rolling_rate(v.requests, QUOTA_WINDOW)


def _saved_windows(v: Views) -> DataFrame:
    """Saved state per group; every third window is too old to count at TASK_AS_OF."""
    groups = v.tasks.filter("rate_limit_group is not null").select("rate_limit_group").distinct()
    number = F.substring("rate_limit_group", 2, 9).cast("int")
    start = F.unix_micros(tasks.instant(TASK_AS_OF)) - F.when(number % 3 == 0, 60_000_000).otherwise(59_999_999)
    return groups.select("rate_limit_group", (number * 2).alias("count"), F.timestamp_micros(start).alias("window_start"))


@query
def admit_due(v: Views) -> DataFrame:
    return quota.admit_due(v.due(), _saved_windows(v), TASK_AS_OF).select(*TASK_KEYS, "admitted")


@query
def admit_due_mixed(v: Views) -> DataFrame:
    due = v.due().withColumn("max_per_minute", F.col("max_per_minute_mixed"))
    return quota.admit_due(due, _saved_windows(v), TASK_AS_OF).select(*TASK_KEYS, "admitted")


@query
def number_attempts(v: Views) -> DataFrame:
    return outcomes.number_attempts(v.attempts, ATTEMPT_ORDER).drop("restarts")


@query
def pace_backlog(v: Views) -> DataFrame:
    return quota.pace_backlog(v.due(), TASK_AS_OF).select(*TASK_KEYS, "queue_rank", "slot", "planned_time")


# --- order


@query
def priority_order(v: Views) -> DataFrame:
    return dispatch.priority_order(v.due()).select(*TASK_KEYS)


@query
def dispatch_batch(v: Views) -> DataFrame:
    return dispatch.dispatch_batch(v.due()).select(*TASK_KEYS)


# --- transitions and schedules


@query
def apply_results(v: Views) -> DataFrame:
    moved = outcomes.apply_results(v.task_rows(), v.first_outcomes(), TASK_AS_OF)
    return moved.select(
        "task_id", "transition", "retry_count", "execute_at", "retry_after_time", "deleted_at", "last_error_obj",
        F.col("last_job_error.error").alias("job_error"),
    )


@query
def apply_attempts(v: Views) -> DataFrame:
    """Versions after all attempts of each task, not its first alone."""
    moved = outcomes.apply_attempts(v.task_rows(), v.attempts, ATTEMPT_ORDER)
    return moved.select(
        "task_id", "transition", "attempts", "retry_count", "execute_at", "retry_after_time", "deleted_at", "last_error_obj",
        F.col("last_job_error.error").alias("job_error"),
    )


@query
def reschedule_cron(v: Views) -> DataFrame:
    succeeded = tasks.live_tasks(v.task_rows()).join(v.first_outcomes().filter("ok").select("task_id"), "task_id", "left_semi")
    return schedule.reschedule_cron(succeeded, TASK_AS_OF).select(
        "task_id", "execute_at", "retry_after_time", "retry_count", "deleted_at", "last_error_obj"
    )


@query
def defer_denied(v: Views) -> DataFrame:
    denied = quota.admit_due(v.due(), _saved_windows(v), TASK_AS_OF).filter(~F.col("admitted"))
    return quota.defer_denied(denied, TASK_AS_OF).select("task_id", "retry_count", "retry_after_time")


@query
def dead_letters(v: Views) -> DataFrame:
    return outcomes.dead_letters(v.tasks, v.first_outcomes())


def _schedules(v: Views) -> DataFrame:
    return v.schedules.withColumn("cron_expression", normalize_cron(F.col("cron"))).drop("cron")


@query
def cron_expand(v: Views) -> DataFrame:
    return schedule.cron_expand(_schedules(v), TICKS_FROM, TICKS_TO).select("schedule_id", "tick")


@query
def cron_next(v: Views) -> DataFrame:
    return schedule.cron_next(_schedules(v), EVENT_AS_OF).select("schedule_id", "next_tick")


# --- handlers


def _checked(task: dict) -> None:
    """The handler of the handler queries: refuses every third task."""
    if int(task["task_id"]) % 3 == 0:
        raise ValueError(f"refused {task['task_id']}")


@query
def run_handlers(v: Views) -> DataFrame:
    return handlers.run_handlers(v.due(), {f"type{i}": _checked for i in range(5)})


@query
def run_max_retry_handlers(v: Views) -> DataFrame:
    letters = outcomes.dead_letters(v.tasks, v.first_outcomes())
    return handlers.run_max_retry_handlers(letters, {f"type{i}": _checked for i in range(5)})

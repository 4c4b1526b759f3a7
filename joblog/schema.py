"""Record shapes: task versions, protocol messages, quota windows.

Columns are snake_case everywhere inside the package. Two name maps translate to
the JSON keys of the task log (camelCase) and of webhook bodies; message keys
are already snake_case.
"""

from __future__ import annotations

from pyspark.sql import types as T

# JSON keys of a task-log line, by column, in record order.
TASK_LOG_KEYS = {
    "task_id": "taskId",
    "retry_count": "retryCount",
    "max_retries": "maxRetries",
    "retry_after_hours": "retryAfterHours",
    "retry_after_time": "retryAfterTime",
    "task_data": "taskData",
    "task_type": "taskType",
    "last_error_obj": "LastErrorObj",
    "last_job_error": "LastJobError",
    "rate_limit_group": "rateLimitGroup",
    "max_per_minute": "maxPerMinute",
    "auto_dedupe": "autoDedupe",
    "urgency_score": "urgencyScore",
    "payload_hash": "payloadHash",
    "deleted_at": "deletedAt",
    "execute_at": "executeAt",
    "cron_expression": "cronExpression",
    "webhook_url": "webhookUrl",
    "max_execution_seconds": "maxExecutionSeconds",
}

# Keys of a webhook body, by column.
WEBHOOK_KEYS = {"task_id": "taskId", "task_type": "taskType", "task_data": "data"}

JOB_ERROR = T.StructType(
    [T.StructField("error", T.StringType()), T.StructField("retry_worthy", T.BooleanType())]
)

TASK_TYPES = {
    "task_id": T.StringType(),
    "retry_count": T.IntegerType(),
    "max_retries": T.IntegerType(),
    "retry_after_hours": T.DoubleType(),
    "retry_after_time": T.TimestampType(),
    "task_data": T.StringType(),
    "task_type": T.StringType(),
    "last_error_obj": T.StringType(),
    "last_job_error": JOB_ERROR,
    "rate_limit_group": T.StringType(),
    "max_per_minute": T.IntegerType(),
    "auto_dedupe": T.BooleanType(),
    "urgency_score": T.DoubleType(),
    "payload_hash": T.StringType(),
    "deleted_at": T.TimestampType(),
    "execute_at": T.TimestampType(),
    "cron_expression": T.StringType(),
    "webhook_url": T.StringType(),
    "max_execution_seconds": T.LongType(),
}
TASK_COLUMNS = list(TASK_TYPES)
TASK_REQUIRED = [
    "task_id",
    "retry_count",
    "max_retries",
    "retry_after_hours",
    "retry_after_time",
    "task_data",
    "task_type",
    "execute_at",
]
TASK_SCHEMA = T.StructType([T.StructField(c, t) for c, t in TASK_TYPES.items()])

CORRUPT = "_corrupt_record"

# Timestamps stay text while a log line is decoded, so that only RFC 3339 passes.
TASK_LINE_SCHEMA = T.StructType(
    [
        T.StructField(key, T.StringType() if isinstance(TASK_TYPES[c], T.TimestampType) else TASK_TYPES[c])
        for c, key in TASK_LOG_KEYS.items()
    ]
    + [T.StructField(CORRUPT, T.StringType())]
)

MESSAGE_TYPES = {
    "action": T.StringType(),
    "task_id": T.StringType(),
    "task_type": T.StringType(),
    "task_data": T.StringType(),
    "max_retries": T.IntegerType(),
    "retry_after_hours": T.DoubleType(),
    "rate_limit_group": T.StringType(),
    "max_per_minute": T.IntegerType(),
    "auto_dedupe": T.BooleanType(),
    "urgency_score": T.DoubleType(),
    "execute_at": T.StringType(),
    "cron": T.StringType(),
    "webhook_url": T.StringType(),
    "max_execution_seconds": T.LongType(),
    "data": T.StringType(),
    "status": T.StringType(),
    "error_msg": T.StringType(),
}
MESSAGE_SCHEMA = T.StructType(
    [T.StructField(c, t) for c, t in MESSAGE_TYPES.items()] + [T.StructField(CORRUPT, T.StringType())]
)

# Inbound actions, their required and their optional fields.
INBOUND_REQUIRED = {
    "register": ["task_type"],
    "enqueue": ["task_id", "task_type", "task_data", "max_retries", "retry_after_hours"],
    "progress": ["task_id", "data"],
    "result": ["task_id", "status"],
    "stats": [],
}
INBOUND_OPTIONAL = {
    "register": [],
    "enqueue": [
        "rate_limit_group",
        "max_per_minute",
        "auto_dedupe",
        "urgency_score",
        "execute_at",
        "cron",
        "webhook_url",
        "max_execution_seconds",
    ],
    "progress": [],
    "result": ["error_msg"],
    "stats": [],
}

# Outbound actions and the fields written for each.
OUTBOUND_FIELDS = {
    "execute": ["task_id", "task_type", "task_data", "max_execution_seconds"],
    "max_retries_reached": ["task_id", "task_type", "task_data"],
    "ack": ["task_id", "message"],
    "progress": ["task_id", "data"],
    "error": ["task_id", "message"],
    "stats": [
        "total_enqueued",
        "total_executed",
        "total_failed",
        "total_dlq",
        "queue_depth",
        "uptime_secs",
    ],
}

RATE_WINDOWS = T.MapType(
    T.StringType(),
    T.StructType([T.StructField("count", T.IntegerType()), T.StructField("window_start", T.StringType())]),
)

"""Job-log analytics on Spark: replay, dedupe, quotas, outcomes, schedules, streams."""

"""Column-level rules: record construction, time, cron and payload identity."""

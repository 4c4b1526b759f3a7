"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``$BENCH_RUNS`` times (default 3); its
figure is the median. Every run writes the whole result to the noop sink. Text
inputs are stored before timing, as users have them. ``control`` is a fixed
amount of work on one core, to tell a slow machine from a slow query; it is not
part of the total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from joblog import queries as module  # noqa: E402
from joblog.queries import Views, plain, queries  # noqa: E402
from joblog.session import build_session  # noqa: E402

# Query, and the table whose rows it works through.
HEADLINE = {
    "latest_tasks": "events",
    "dedupe_in_flight": "events",
    "admit_quota": "events",
    "admit_quota_mixed": "events",
    "match_results": "events",
    "timed_out": "events",
    "queue_stats": "events",
    "number_attempts": "lineitem",
    "attempt_summary": "lineitem",
    "apply_results": "lineitem",
    "admit_due": "orders",
    "pace_backlog": "orders",
    "dispatch_batch": "orders",
    "cron_expand": "supplier",
    "build_tasks": "events",
    "valid_log_rows": "events",
    "payload_key": "documents",
    "assemble_progress": "conversations",
    "admit_quota_resumed": "events",
    "run_handlers": "orders",
}


# Queries whose input is text that the views would compose anew each time.
STORED = ("valid_log_rows", "queue_stats", "build_tasks")


class StoredViews(Views):
    """The views, with the text ones read from Parquet."""

    def __init__(self, spark, sf_dir: str):
        super().__init__(spark, sf_dir)
        root = tempfile.mkdtemp(prefix="joblog-bench-")
        for name in ("task_lines", "messages"):
            Views(spark, sf_dir).__getattr__(name).write.parquet(f"{root}/{name}")
            setattr(self, name, spark.read.parquet(f"{root}/{name}"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "joblog-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    stored = StoredViews(spark, sf_dir)
    for name in STORED:
        registered[name] = lambda *_, name=name: plain(getattr(module, name)(stored))
    registered["control"] = lambda spark, _: spark.range(0, 150_000_000, 1, 1).selectExpr("sum(id * 7 % 13) AS s")
    seconds, rates = {}, {}
    for name, table in (HEADLINE | {"control": "events"}).items():
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        rates[name] = round(rows / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(s for n, s in seconds.items() if n != "control"), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

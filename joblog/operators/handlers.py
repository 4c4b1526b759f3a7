"""User code over task rows.

A handler is a function of one task (a dict of its columns). Returning means
success; an exception is the task's error. Spark may run a task again after a
lost executor, so handlers have to be idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Handler = Callable[[dict], object]


def _calls(handlers: Mapping[str, Handler]):
    table = dict(handlers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for task in batch.to_dict("records"):
                try:
                    table[task["task_type"]](task)
                    out.append((task["task_id"], True, None))
                except Exception as error:  # noqa: BLE001 - any failure is the task's outcome
                    out.append((task["task_id"], False, str(error)))
            yield pd.DataFrame(out, columns=["task_id", "ok", "error"]).astype({"ok": "bool"})

    return run


def run_handlers(df: DataFrame, handlers: Mapping[str, Handler]) -> DataFrame:
    """Run each row through the handler of its type: (task_id, ok, error).

    Rows without a handler, and webhook rows, give no outcome.
    """
    handled = df.filter(F.col("task_type").isin(list(handlers)))
    if "webhook_url" in df.columns:
        handled = handled.filter(F.col("webhook_url").isNull())
    return handled.mapInPandas(_calls(handlers), "task_id string, ok boolean, error string")


def run_max_retry_handlers(df: DataFrame, handlers: Mapping[str, Handler]) -> DataFrame:
    """Run dead letters through the handler of their type; errors are ignored: (task_id)."""
    return run_handlers(df, handlers).select("task_id")

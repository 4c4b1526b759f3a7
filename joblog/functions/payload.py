"""Identity of a job payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload_key(task_type: Column, task_data: Column, auto_dedupe: Column | None = None, compat: bool = False) -> Column:
    """Key that is equal for equal (type, data); null unless dedupe was asked for.

    The length prefix keeps ("ab", "c") apart from ("a", "bc"). ``compat=True``
    drops it, which keeps the ambiguity of plain concatenation.
    """
    joined = F.concat(task_type, task_data)
    if not compat:
        joined = F.concat(F.length(task_type).cast("string"), F.lit(":"), joined)
    key = F.sha2(joined, 256)
    return key if auto_dedupe is None else F.when(F.coalesce(auto_dedupe, F.lit(False)), key)

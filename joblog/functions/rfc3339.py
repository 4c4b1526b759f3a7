"""RFC 3339 text to UTC timestamps and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's own cast also takes dates and partial times; this guard does not.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_rfc3339(text: Column) -> Column:
    """UTC timestamp, or null when the text is not RFC 3339; a leap second is the next minute's first."""
    normal = F.upper(text)
    leap = F.substring(normal, 18, 2) == "60"
    plain = F.when(leap, F.concat(F.substring(normal, 1, 17), F.lit("59"), F.substring(normal, 20, 100))).otherwise(normal)
    micros = F.unix_micros(plain.try_cast("timestamp")) + F.when(leap, 1_000_000).otherwise(0)
    return F.when(text.rlike(RFC3339), F.timestamp_micros(micros))


def format_rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

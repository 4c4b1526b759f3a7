"""Cron expressions: shorthand normalisation, next tick, parsed fields.

An expression has six or seven fields, seconds first: second, minute, hour, day
of month, month, day of week, year. Day of month and day of week must both
match. Weekdays are names or 1 (Sunday) to 7. ``*/N`` counts from the lowest
value of the field.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U32_MAX = 4294967295

# Lowest and highest value of each field.
BOUNDS = {
    "seconds": (0, 59),
    "minutes": (0, 59),
    "hours": (0, 23),
    "days": (1, 31),
    "months": (1, 12),
    "weekdays": (1, 7),
    "years": (1970, 2100),
}
FIELDS = list(BOUNDS)

# Names of months and weekdays, in field order.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
WEEKDAYS = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]
_NAMES = {
    "months": {name: i for i, name in enumerate(MONTHS, 1)},
    "weekdays": {name: i for i, name in enumerate(WEEKDAYS, 1)},
}
_SPAN = re.compile(r"^(\*|\?|[A-Z]+|\d+)(?:-([A-Z]+|\d+))?(?:/(\d+))?$")
_EPOCH = dt.datetime(1970, 1, 1)
_MICRO = dt.timedelta(microseconds=1)

# Shorthand suffix to expression.
SHORTHANDS = {
    "s": "*/%s * * * * *",
    "m": "0 */%s * * * *",
    "h": "0 0 */%s * * *",
    "d": "0 0 0 */%s * *",
}


def normalize_cron(text: Column) -> Column:
    """Shorthands (``10m``) and 5- or 6-field expressions to the full form."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    digits = F.regexp_extract(trimmed, r"^\+?([0-9]+)[smhd]$", 1)
    count = digits.try_cast("decimal(38,0)")
    number = F.when(count <= U32_MAX, count.cast("bigint").cast("string"))
    suffix = F.right(trimmed, F.lit(1))
    short = F.coalesce(
        *[
            F.when(suffix == unit, F.concat(F.lit(form.split("%s")[0]), number, F.lit(form.split("%s")[1])))
            for unit, form in SHORTHANDS.items()
        ]
    )
    fields = F.when(trimmed != "", F.size(F.split(trimmed, r"\s+"))).otherwise(0)
    return (
        F.when(number.isNotNull(), short)
        .when(fields == 5, F.concat(F.lit("0 "), trimmed, F.lit(" *")))
        .when(fields == 6, F.concat(trimmed, F.lit(" *")))
        .otherwise(trimmed)
    )


def _value(token: str, names: dict[str, int]) -> int | None:
    return int(token) if token.isdigit() else names.get(token[:3]) if len(token) >= 3 else None


def _field(text: str, field: str) -> list[int] | None:
    low, high = BOUNDS[field]
    names = _NAMES.get(field, {})
    found: set[int] = set()
    for part in text.upper().split(","):
        match = _SPAN.match(part)
        if not match:
            return None
        first, last, step = match.groups()
        if first in ("*", "?"):
            if last:
                return None
            start, stop = low, high
        else:
            start = _value(first, names)
            stop = _value(last, names) if last else (high if step else start)
        by = int(step) if step else 1
        if start is None or stop is None or not low <= start <= stop <= high or not 1 <= by <= high:
            return None
        found.update(range(start, stop + 1, by))
    return sorted(found)


def parse_cron(expression: str | None) -> dict[str, list[int]] | None:
    """Allowed values per field, or None when the expression is not valid."""
    parts = (expression or "").split()
    if len(parts) == 6:
        parts.append("*")
    if len(parts) != 7:
        return None
    fields = {name: _field(text, name) for name, text in zip(FIELDS, parts)}
    return None if any(v is None for v in fields.values()) else fields


def _days(fields: dict[str, list[int]], start: dt.date) -> Iterator[dt.date]:
    for year in fields["years"]:
        for month in fields["months"] if year >= start.year else []:
            for day in fields["days"]:
                try:
                    date = dt.date(year, month, day)
                except ValueError:
                    break
                if date >= start and date.isoweekday() % 7 + 1 in fields["weekdays"]:
                    yield date


def next_tick(fields: dict[str, list[int]], after: dt.datetime) -> dt.datetime | None:
    """First tick strictly later than ``after``."""
    earliest = after.replace(microsecond=0) + dt.timedelta(seconds=1)
    for date in _days(fields, earliest.date()):
        bound = earliest.time() if date == earliest.date() else dt.time.min
        for hour in fields["hours"]:
            if hour < bound.hour:
                continue
            for minute in fields["minutes"]:
                for second in fields["seconds"]:
                    if dt.time(hour, minute, second) >= bound:
                        return dt.datetime.combine(date, dt.time(hour, minute, second))
    return None


@F.pandas_udf(T.LongType())
def _next_tick_micros(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    parsed: dict[str, dict | None] = {}
    answers: dict[tuple[str, int], int | None] = {}
    for expressions, afters in batches:
        # Only the distinct (expression, time) pairs of a batch are worked out; rows take theirs by code.
        texts, text_of = pd.factorize(expressions)
        times, time_of = pd.factorize(afters)
        known = (texts >= 0) & (times >= 0)
        codes, pairs = pd.factorize(np.where(known, texts.astype(np.int64) * max(len(time_of), 1) + times, -1))
        ticks = np.empty(len(pairs), dtype=object)
        for i, pair in enumerate(pairs.tolist()):
            if pair < 0:
                continue
            key = (text_of[pair // len(time_of)], int(time_of[pair % len(time_of)]))
            if key not in answers:
                if len(answers) > 100_000:
                    answers.clear()
                if len(parsed) > 100_000:
                    parsed.clear()
                if key[0] not in parsed:
                    parsed[key[0]] = parse_cron(key[0])
                fields = parsed[key[0]]
                tick = fields and next_tick(fields, _EPOCH + dt.timedelta(microseconds=key[1]))
                answers[key] = (tick - _EPOCH) // _MICRO if tick else None
            ticks[i] = answers[key]
        yield pd.Series(ticks[codes] if len(codes) else [], dtype="object")


def next_tick_column(expression: Column, after: Column) -> Column:
    """First tick after a timestamp; null for a bad or finished expression.

    A vectorised UDF next to the data rather than a join on the expression: one
    popular schedule would be a hot join key. Each worker parses an expression
    once and answers a repeated (expression, time) from memory.
    """
    return F.timestamp_micros(_next_tick_micros(expression, F.unix_micros(after)))


_FIELD_ARRAYS = T.StructType([T.StructField(name, T.ArrayType(T.IntegerType())) for name in FIELDS])


@F.pandas_udf(_FIELD_ARRAYS)
def cron_fields(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Struct of allowed values per field; all null for a bad expression."""
    parsed: dict[str | None, dict | None] = {}
    for expressions in batches:
        rows = []
        for expression in expressions:
            if expression not in parsed:
                if len(parsed) > 100_000:
                    parsed.clear()
                parsed[expression] = parse_cron(expression)
            rows.append(parsed[expression] or dict.fromkeys(FIELDS))
        yield pd.DataFrame(rows, columns=FIELDS, dtype="object")

"""Per-group quotas: admission over time, in one tick, and their upkeep.

The request order inside a group is sequential by definition, but a hot group is
not one task here. Anchored windows only depend on where the last window began,
so each time slice of a hot group first reports, for every possible last anchor
before the slice, the last anchor inside it. Reports of neighbouring slices are
combined into one per stretch; following the few stretches, and then the slices
inside each stretch, gives every slice its real starting anchor. After that the
slices are folded independently.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblog.operators.dispatch import priority_keys
from joblog.operators.dedupe import BEFORE
from joblog.operators.tasks import instant, plus_seconds, quota_bound
from joblog.plans.ordered import CHUNK, HOT, HOT_ROWS, cut, floor_div, hot_keys, number_rows, time_chunk
from joblog.plans.runs import key_runs

# Length of a quota window and of the deferral after a denial.
WINDOW_SECONDS = 60
DEFERRAL_SECONDS = 60
# A time slice of a hot group spans this many windows; one of them is lent to the next slice.
WINDOWS_PER_SLICE = 4
# A stretch spans this many slices.
SLICES_PER_STRETCH = 64

GROUP, LIMIT = "rate_limit_group", "max_per_minute"
# How many requests a row stands for; rows without one stand for themselves.
WEIGHT = "__weight"


_REPORT = f"{GROUP} string, __slice bigint, __upto bigint, __leave bigint"
_ENTRY = f"{GROUP} string, __slice bigint, __entry bigint"
_OPEN_END = np.iinfo(np.int64).max
_EMIT_ROWS = 50_000
# Stands for null in folds; below every limit, count and instant.
_NONE = np.iinfo(np.int64).min


def _records(names: list[str], parts: list[tuple]) -> pa.RecordBatch:
    """Rows of (group, slice, array, ...) parts; the arrays of a part are equally long."""
    lengths = [len(part[2]) for part in parts]
    groups = pa.array(np.repeat(np.array([p[0] for p in parts], dtype=object), lengths), pa.string())
    slices = pa.array(np.repeat(np.array([p[1] for p in parts], dtype=np.int64), lengths))
    rest = [pa.array(np.concatenate([p[i] for p in parts])) for i in range(2, len(parts[0]))]
    return pa.RecordBatch.from_arrays([groups, slices, *rest], names=names)


def _ends_of_runs(values: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(values[1:] != values[:-1]), len(values) - 1)


def _anchor_reports(width: int, span: int):
    """Sorted (group, slice, ts) rows to: last anchor inside a slice, per last anchor before it.

    A row (upto, leave) says: when the window before the slice ends at or before
    ``upto`` (and after the row above), the last anchor in the slice is
    ``leave``. No row covering it means that the window outlasts the slice.
    """

    def report(key: tuple, parts: list[np.ndarray]) -> tuple:
        ts = np.concatenate(parts)
        ts = ts[_ends_of_runs(ts)]
        n = len(ts)
        follow = np.searchsorted(ts, ts + width, "left")
        last = np.where(follow == n, np.arange(n), follow)
        while True:  # pointer doubling: log2(windows per slice) rounds
            jump = last[last]
            if np.array_equal(jump, last):
                break
            last = jump
        # A window that began before the slice ends within ``width`` of its start.
        reach = min(int(np.searchsorted(ts, key[1] * span + width, "left")), n - 1) + 1
        leave = ts[last[:reach]]
        keep = _ends_of_runs(leave)
        return (*key, ts[keep], leave[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [GROUP, "__slice", "__upto", "__leave"]
        key, parts, out = None, [], []
        for batch in batches:
            ts = batch.column("__ts").to_numpy()
            for run_key, start, stop in key_runs(batch, [GROUP, "__slice"]):
                if run_key != key:
                    if parts:
                        out.append(report(key, parts))
                    key, parts = run_key, []
                own = ts[start:stop]
                parts.append(own[_ends_of_runs(own)])
            if sum(len(p[2]) for p in out) > _EMIT_ROWS:
                yield _records(names, out)
                out = []
        if parts:
            out.append(report(key, parts))
        if out:
            yield _records(names, out)

    return run


def _combine_reports(width: int):
    """Sorted reports of the slices of a stretch to the reports of the stretch."""

    def through(anchors: np.ndarray, uptos: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        at = np.searchsorted(uptos, anchors + width)
        return np.where(at < len(uptos), leaves[np.minimum(at, len(uptos) - 1)], anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [GROUP, "__slice", "__upto", "__leave"]
        key, number, parts, ends, anchors = None, None, [], None, None

        def add_slice() -> None:
            nonlocal ends, anchors
            uptos, leaves = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            if ends is None:
                ends, anchors = uptos, leaves
                return
            moved = through(anchors, uptos, leaves)
            if ends[-1] != _OPEN_END:
                # A window that outlasts the first slice is over before the second.
                ends, moved = np.append(ends, _OPEN_END), np.append(moved, leaves[0])
            keep = _ends_of_runs(moved)
            ends, anchors = ends[keep], moved[keep]

        for batch in batches:
            uptos, leaves = batch.column("__upto").to_numpy(), batch.column("__leave").to_numpy()
            for (group, stretch, slice_), start, stop in key_runs(batch, [GROUP, "__stretch", "__slice"]):
                if ((group, stretch), slice_) != (key, number):
                    if parts:
                        add_slice()
                    if (group, stretch) != key:
                        if ends is not None:
                            yield _records(names, [(*key, ends, anchors)])
                        key, ends, anchors = (group, stretch), None, None
                    number, parts = slice_, []
                parts.append((uptos[start:stop].copy(), leaves[start:stop].copy()))
        if parts:
            add_slice()
            yield _records(names, [(*key, ends, anchors)])

    return run


def _follow_reports(width: int, outer: list[str], with_entries: bool):
    """Walk reports in order; yield the last anchor before each slice.

    Reports of one ``outer`` key are walked from its entry row, if it has one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, anchor, settled = None, None, None, False
        for batch in batches:
            found: list[tuple] = []
            uptos, leaves = batch.column("__upto").to_numpy(zero_copy_only=False), batch.column("__leave").to_numpy(zero_copy_only=False)
            entries = batch.column("__entry").to_pylist() if with_entries else None
            for run_key, start, stop in key_runs(batch, [*outer, "__slice"]):
                if run_key[:-1] != key:
                    key, number, anchor = run_key[:-1], None, None
                if with_entries and entries[start] is not None:
                    anchor = entries[start]
                    continue
                if run_key[-1] != number:
                    number, settled = run_key[-1], False
                    if anchor is not None:
                        found.append((key[0], number, anchor))
                if settled:
                    continue
                # Reports of a slice ascend; the first that covers the open window holds.
                at = start if anchor is None else start + int(np.searchsorted(uptos[start:stop], anchor + width))
                if at < stop:
                    anchor, settled = int(leaves[at]), True
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                names=[GROUP, "__slice", "__entry"],
            )

    return run


def _entries(hot: DataFrame, width: int, span: int, slices_per_stretch: int) -> DataFrame:
    """(group, slice, entry): the last anchor before each slice of the hot groups."""
    reports = (
        hot.select(GROUP, "__slice", "__ts")
        .repartition(GROUP, "__slice")
        .sortWithinPartitions(GROUP, "__slice", "__ts")
        .mapInArrow(_anchor_reports(width, span), _REPORT)
        .withColumn("__stretch", floor_div(F.col("__slice"), slices_per_stretch))
    )
    stretches = (
        reports.repartition(GROUP, "__stretch")
        .sortWithinPartitions(GROUP, "__stretch", "__slice", "__upto")
        .mapInArrow(_combine_reports(width), _REPORT)
    )
    stretch_entries = (
        stretches.repartition(GROUP)
        .sortWithinPartitions(GROUP, "__slice", "__upto")
        .mapInArrow(_follow_reports(width, [GROUP], False), _ENTRY)
        .select(GROUP, F.col("__slice").alias("__stretch"), "__entry")
    )
    return (
        reports.withColumn("__entry", F.lit(None).cast("bigint"))
        .unionByName(stretch_entries, allowMissingColumns=True)
        .repartition(GROUP, "__stretch")
        .sortWithinPartitions(
            F.col(GROUP), F.col("__stretch"), F.col("__slice").asc_nulls_first(), F.col("__upto")
        )
        .mapInArrow(_follow_reports(width, [GROUP, "__stretch"], True), _ENTRY)
        .filter(F.col("__entry") > F.col("__slice") * span - width)
    )


def _numbers(batch: pa.RecordBatch, name: str, missing: int | None = None) -> list:
    """A column as Python numbers (nulls as ``missing``); much faster than ``to_pylist``."""
    column = batch.column(name)
    if missing is not None:
        wide = column.cast(pa.int64()) if pa.types.is_integer(column.type) else column
        column = wide.fill_null(missing)
    return column.to_numpy(zero_copy_only=False).tolist()


def _append(batch: pa.RecordBatch, keep: list[bool], columns: dict[str, pa.Array], names: list[str]):
    rows = batch.filter(pa.array(keep, pa.bool_()))
    by_name = {n: rows.column(n) for n in rows.schema.names} | columns
    return pa.RecordBatch.from_arrays([by_name[n] for n in names], names=names)


def _anchored_fold(width: int, names: list[str]):
    """Admit in order inside each (group, slice), starting from the slice's entry anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entry, start, count = None, None, None, 0
        for batch in batches:
            keep, admitted, starts, counts = [], [], [], []
            stamps, limits = _numbers(batch, "__ts", 0), _numbers(batch, LIMIT, 0)
            weights = _numbers(batch, WEIGHT, 1) if WEIGHT in names else None
            own, entries = _numbers(batch, "__own", False), _numbers(batch, "__entry", _NONE)
            for run_key, first, stop in key_runs(batch, [GROUP, "__slice"]):
                if run_key != key:
                    key, entry, start, count = run_key, None, None, 0
                for i in range(first, stop):
                    if entries[i] != _NONE:
                        entry = entries[i]
                        keep.append(False)
                        continue
                    ts, mine = stamps[i], own[i]
                    keep.append(mine)
                    # Rows lent by the slice before only count inside the open window.
                    if not mine and (entry is None or ts < entry):
                        continue
                    if start is None or ts - start >= width:
                        start, count = ts, 0
                    allow = count < limits[i]
                    count += allow if weights is None else allow * weights[i]
                    if mine:
                        admitted.append(allow)
                        starts.append(start)
                        counts.append(count)
            yield _append(
                batch,
                keep,
                {
                    "admitted": pa.array(admitted, pa.bool_()),
                    "__start": pa.array(starts, pa.int64()),
                    "window_count": pa.array(counts, pa.int32()),
                },
                names,
            )

    return run


def _room(limits: np.ndarray, at: int, end: int, count: int) -> int:
    """The first place from ``at`` whose limit is over ``count``, or ``end``; reads little more than it passes."""
    step = 16
    while at < end:
        found = np.flatnonzero(limits[at : min(at + step, end)] > count)
        if len(found):
            return at + int(found[0])
        at, step = at + step, 4 * step
    return end


def _rolling_fold(width: int, names: list[str]):
    """Admit in order inside each (group, burst).

    Until the oldest admission leaves the window, a row that finds no room
    leaves everything as it is, so the fold goes on at the next row with a limit
    above the count: beyond the admissions, a burst costs array scans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, recent = None, deque()
        for batch in batches:
            n = batch.num_rows
            stamps, limits, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__ts", LIMIT, "__own"))
            admitted, starts, counts = np.zeros(n, bool), np.full(n, _NONE), np.zeros(n, np.int32)
            for run_key, first, stop in key_runs(batch, [GROUP, "__burst"]):
                if run_key != key:
                    key, recent = run_key, deque()
                at = first
                while at < stop:
                    ts = int(stamps[at])
                    if not own[at]:  # lent: admitted before
                        recent.append(ts)
                        at += 1
                        continue
                    while recent and ts - recent[0] >= width:
                        recent.popleft()
                    count = len(recent)
                    if limits[at] > count:
                        recent.append(ts)
                        admitted[at], starts[at], counts[at] = True, recent[0], count + 1
                        at += 1
                        continue
                    leaves = at + int(np.searchsorted(stamps[at:stop], recent[0] + width)) if recent else stop
                    room = _room(limits, at, leaves, count)
                    if recent:
                        starts[at:room] = recent[0]
                    counts[at:room] = count
                    at = room
            yield _append(
                batch,
                own.tolist(),
                {
                    "admitted": pa.array(admitted[own]),
                    "__start": pa.array(starts[own], mask=starts[own] == _NONE),
                    "window_count": pa.array(counts[own]),
                },
                names,
            )

    return run


def _fold_schema(requests: DataFrame) -> T.StructType:
    return T.StructType(
        requests.schema.fields
        + [
            T.StructField("admitted", T.BooleanType()),
            T.StructField("__start", T.LongType()),
            T.StructField("window_count", T.IntegerType()),
        ]
    )


def _lend(stamped: DataFrame, slices: str, width: int, span: int) -> DataFrame:
    """Copy the rows of the last window of a hot group's slice to the next slice (``__own`` false)."""
    lent = F.col(HOT) & (F.pmod(F.col("__ts"), F.lit(span)) > span - width)
    shifts = F.when(lent, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        stamped.withColumn("__shift", F.explode(shifts))
        .withColumns({slices: F.col(slices) + F.col("__shift"), "__own": F.col("__shift") == 0})
        .drop("__shift", HOT)
    )


def _admit_anchored(stamped: DataFrame, schema: T.StructType, width: int, span: int, stretch: int) -> DataFrame:
    in_slices = stamped.withColumnRenamed(CHUNK, "__slice")
    spread = _lend(in_slices, "__slice", width, span).withColumn("__entry", F.lit(None).cast("bigint"))
    return (
        spread.unionByName(_entries(in_slices.filter(HOT), width, span, stretch), allowMissingColumns=True)
        .repartition(GROUP, "__slice")
        .sortWithinPartitions(
            F.col(GROUP), F.col("__slice"), F.col("__entry").desc_nulls_last(), F.col("__ts"), F.col("seq")
        )
        .mapInArrow(_anchored_fold(width, schema.names), schema)
    )


def _trailing(rows: DataFrame, width: int) -> DataFrame:
    """Add ``trailing``: rows of the group and chunk in the ``width`` up to each row's instant.

    A row counts from its instant on, and no more ``width`` later, so a running
    sum over both turns tells. Its work follows the rows, while a sliding frame
    is counted anew wherever it moves.
    """
    turns = rows.repartition(GROUP, CHUNK).withColumn("__turn", F.explode(F.array(F.lit(1), F.lit(-1))))
    turns = turns.filter("__turn = 1 or __ts is not null").withColumn("__at", F.col("__ts") + F.when(F.col("__turn") < 0, width).otherwise(0))
    so_far = Window.partitionBy(GROUP, CHUNK, F.isnull("__ts")).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("trailing", F.sum("__turn").over(so_far)).filter("__turn = 1").drop("__turn", "__at")


def _rolling_bursts(stamped: DataFrame, width: int, span: int) -> DataFrame:
    """Rows of hot groups with ``__burst``, what can be folded on its own, and ``__own``; lent rows go before it.

    A burst begins after a gap of a whole window. It also begins with a slice if
    no request of the window before the slice is congested, that is has more
    requests in its trailing window than its limit: all of them are admitted
    then, whatever came before, so they are lent to the slice as they are.
    """
    in_slice = Window.partitionBy(GROUP, CHUNK).orderBy("__ts")
    gap = F.col("__ts") - F.lag("__ts").over(in_slice) >= width
    seen = _lend(stamped.filter(HOT), CHUNK, width, span)
    inside = seen.withColumn("__inner", F.when(gap, F.col("__ts"))).filter("__own")
    # Of a slice, its last window and the one before that are all that its congestion depends on.
    into = F.col("__ts") - F.col(CHUNK) * F.lit(span)
    counted = _trailing(seen.select(GROUP, CHUNK, "__ts", LIMIT, "__own").filter(into > span - 2 * width), width)
    congested = counted.filter(F.col("__own") & (into >= span - width) & (F.col("trailing") > F.col(LIMIT)))
    jams = congested.select(GROUP, CHUNK, F.lit(True).alias("__jam")).distinct()
    across = Window.partitionBy(GROUP).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__before")
    free = ~(F.lag("__jam").over(across) & (F.lag(CHUNK).over(across) == F.col(CHUNK) - 1))
    opening = (
        inside.groupBy(GROUP, CHUNK)
        .agg(F.min("__ts").alias("__min"), F.max("__ts").alias("__max"), F.max("__inner").alias("__inner"))
        .join(jams, [GROUP, CHUNK], "left")
        .withColumn("__jam", F.coalesce("__jam", F.lit(False)))
        .withColumns({"__before": F.lag("__max").over(across), "__free": free})
        .withColumn("__opens", F.when(before.isNull() | (F.col("__min") - before >= width) | F.col("__free"), F.col("__min")))
        .withColumn("__starts", F.coalesce("__inner", "__opens"))
        .select(
            GROUP,
            CHUNK,
            "__opens",
            F.coalesce(F.col("__opens"), F.last("__starts", ignorenulls=True).over(earlier)).alias("__opening"),
        )
    )
    so_far = in_slice.rangeBetween(Window.unboundedPreceding, 0)
    own = inside.withColumn("__burst", F.max("__inner").over(so_far)).join(opening, [GROUP, CHUNK])
    own = own.withColumn("__burst", F.coalesce("__burst", "__opening"))
    # A slice that begins a burst borrows the window before it; one that goes on with a burst has it.
    lent = seen.filter(~F.col("__own")).join(opening.filter("__opens is not null"), [GROUP, CHUNK])
    columns = [*stamped.drop(HOT).columns, "__own", "__burst"]
    return own.select(*columns).unionByName(lent.withColumn("__burst", F.col("__opens")).select(*columns))


def _admit_rolling(stamped: DataFrame, schema: T.StructType, width: int, span: int) -> DataFrame:
    """Fold each burst of a hot group, and each other group, in time order."""
    whole = stamped.filter(F.col(HOT).isNull()).drop(HOT).withColumns({"__own": F.lit(True), "__burst": F.lit(0).cast("bigint")})
    return (
        _rolling_bursts(stamped, width, span)
        .unionByName(whole)
        .repartition(GROUP, "__burst")
        .sortWithinPartitions(GROUP, "__burst", "__ts", F.col("__own"), "seq")
        .mapInArrow(_rolling_fold(width, schema.names), schema)
    )


def _replayed(windows: DataFrame, requests: DataFrame) -> DataFrame:
    """One request a group that leaves it at ``windows``: admitted with the weight of the count, or denied if that is zero."""
    count = F.col("count").cast("int")
    return windows.select(
        GROUP,
        F.col("window_start").cast(requests.schema["ts"].dataType).alias("ts"),
        F.lit(BEFORE).cast(requests.schema["seq"].dataType).alias("seq"),
        F.when(count > 0, F.lit(2**31 - 1)).otherwise(0).cast(requests.schema[LIMIT].dataType).alias(LIMIT),
        F.lit(True).alias("__saved"),
        F.greatest(count, F.lit(1)).cast("bigint").alias(WEIGHT),
    )


def admit_quota(
    requests: DataFrame,
    window: int = WINDOW_SECONDS,
    mode: str = "anchored",
    windows_per_slice: int = WINDOWS_PER_SLICE,
    slices_per_stretch: int = SLICES_PER_STRETCH,
    hot_rows: int = HOT_ROWS,
    windows: DataFrame | None = None,
) -> DataFrame:
    """Add ``admitted``, ``window_start`` and ``window_count`` to (seq, ts, group, limit) rows.

    ``anchored``: a window starts at a group's first request and again at the
    first request at least ``window`` seconds later; a request is admitted while
    fewer than its own limit were admitted in the window. ``rolling``: at most
    the limit in any trailing ``window`` seconds; here a hot group is cut at its
    gaps and where a whole window was within its limits, since every admission
    depends on the ones a window back. Rows without a group or a limit are not
    limited.

    ``windows`` (group, count, window_start), for ``anchored`` only, is where
    the groups stand before the requests: one request of that weight at the
    window's start brings a group to the same state, whatever its count, so it
    goes first and is left out again.
    """
    if windows is not None:
        if mode != "anchored":
            raise ValueError("saved windows belong to anchored quotas")
        columns = requests.columns
        everything = requests.withColumn("__saved", F.lit(False)).unionByName(_replayed(windows, requests), allowMissingColumns=True)
        told = admit_quota(everything, window, mode, windows_per_slice, slices_per_stretch, hot_rows)
        return told.filter(~F.col("__saved")).select(*columns, "admitted", "window_start", "window_count")
    width = window * 1_000_000
    span = width * max(windows_per_slice, 1)
    bound = quota_bound(requests)
    schema = _fold_schema(bound)
    stamped = cut(
        bound.withColumn("__ts", F.unix_micros("ts")),
        [GROUP],
        floor_div(F.unix_micros("ts"), span),
        hot_keys(bound, [GROUP], hot_rows),
    )
    if mode == "anchored":
        folded = _admit_anchored(stamped, schema, width, span, slices_per_stretch)
    elif mode == "rolling":
        folded = _admit_rolling(stamped, schema, width, span)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    free = requests.filter(F.col(GROUP).isNull() | F.col(LIMIT).isNull()).withColumns(
        {
            "admitted": F.lit(True),
            "window_start": F.lit(None).cast("timestamp"),
            "window_count": F.lit(None).cast("int"),
        }
    )
    return (
        folded.withColumn("window_start", F.timestamp_micros("__start"))
        .drop("__start")
        .unionByName(free)
        .select(*requests.columns, "admitted", "window_start", "window_count")
    )


def rolling_rate(
    requests: DataFrame,
    window: int = WINDOW_SECONDS,
    windows_per_slice: int = WINDOWS_PER_SLICE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``trailing``: requests of the group in the trailing ``window`` seconds, this one included.

    A row needs rows at most one window back, so a hot group is counted slice
    by slice, with the last window of each slice lent to the next.
    """
    width = window * 1_000_000
    span = width * max(windows_per_slice, 1)
    stamped = cut(
        requests.withColumn("__ts", F.unix_micros("ts")),
        [GROUP],
        floor_div(F.unix_micros("ts"), span),
        hot_keys(requests, [GROUP], hot_rows),
    )
    return _trailing(_lend(stamped, CHUNK, width, span), width).filter("__own").select(*requests.columns, "trailing")


def rate_window_state(requests: DataFrame, window: int = WINDOW_SECONDS, windows: DataFrame | None = None) -> DataFrame:
    """Final (count, window_start) of each group after all requests; groups without one stay at ``windows``."""
    if windows is not None:
        requests = requests.select(*requests.columns).unionByName(_replayed(windows, requests).drop("__saved"), allowMissingColumns=True)
    return (
        quota_bound(admit_quota(requests, window))
        .groupBy(GROUP)
        .agg(F.max_by(F.struct("window_count", "window_start"), F.struct("ts", "seq", "window_count")).alias("__last"))
        .select(GROUP, F.col("__last.window_count").alias("count"), F.col("__last.window_start").alias("window_start"))
    )


# Parts in which a group's rows are struck out before they meet.
SALTS = 16
_TURN = ["task_id", GROUP, LIMIT, "urgency_score", "execute_at"]


def _due_fold(names: list[str], parts: tuple[str, ...] = ()):
    """Keep the rows that are admitted when each group's rows are taken in order.

    A row with ``__used`` set is the group's saved count, and comes first.
    With ``parts``, each part of a group counts alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, count = None, 0
        for batch in batches:
            keep = []
            limits, used = _numbers(batch, LIMIT, _NONE), _numbers(batch, "__used", _NONE)
            for run_group, first, stop in key_runs(batch, [GROUP, *parts]):
                if run_group != group:
                    group, count = run_group, 0
                for i in range(first, stop):
                    if used[i] != _NONE:
                        count = used[i]
                        keep.append(False)
                        continue
                    allow = count < limits[i]
                    count += allow
                    keep.append(allow)
            yield _append(batch, keep, {}, names)

    return run


def admit_due(due: DataFrame, windows: DataFrame, as_of, window: int = WINDOW_SECONDS) -> DataFrame:
    """Add ``admitted`` to due rows: one tick, most urgent first within each group.

    ``windows`` is the saved (group, count, window_start) state. A row that is
    denied among part of its group's rows is denied among all of them (a count
    never shrinks when rows are added), so each task first strikes out what it
    can on its own rows, and then each of SALTS parts of a group on what is
    left. At most the limit per group and part meets in one task per group.
    Only the columns that decide take this way; the admitted ids then mark the
    limited rows, whose ids are unique. Other rows pass by.
    """
    turns = quota_bound(due).select(*_TURN)
    order = [F.col(GROUP), F.col("__used").desc_nulls_last(), *priority_keys()]
    schema = T.StructType([*turns.schema.fields, T.StructField("__used", T.IntegerType())])
    left = (
        turns.withColumn("__used", F.lit(None).cast("int"))
        .sortWithinPartitions(*order)
        .mapInArrow(_due_fold(schema.names), schema)
        .withColumn("__salt", F.pmod(F.xxhash64("task_id"), F.lit(SALTS)))
        .repartition(GROUP, "__salt")
        .sortWithinPartitions(GROUP, "__salt", *order[1:])
        .mapInArrow(_due_fold(schema.names, ("__salt",)), schema)
    )
    fresh = F.unix_micros(instant(as_of)) - F.unix_micros("window_start") < window * 1_000_000
    used = windows.filter(fresh).select(GROUP, F.col("count").cast("int").alias("__used"))
    admitted = (
        left.unionByName(used, allowMissingColumns=True)
        .repartition(GROUP)
        .sortWithinPartitions(*order)
        .mapInArrow(_due_fold(["task_id"]), "task_id string")
        .withColumn("__admitted", F.lit(True))
    )
    limited = F.col(GROUP).isNotNull() & F.col(LIMIT).isNotNull()
    marked = quota_bound(due).join(admitted, "task_id", "left")
    told = marked.select(*due.columns, F.coalesce("__admitted", F.lit(False)).alias("admitted"))
    return told.unionByName(due.filter(~limited).withColumn("admitted", F.lit(True)))


def defer_denied(denied: DataFrame, as_of) -> DataFrame:
    """Denied rows come due again after the deferral; no attempt is counted."""
    return denied.withColumn("retry_after_time", plus_seconds(instant(as_of), DEFERRAL_SECONDS))


def pace_backlog(backlog: DataFrame, as_of, window: int = WINDOW_SECONDS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``slot`` and ``planned_time``: when a backlog with one limit per group gets its turn.

    Rank within the group by priority, ``limit`` rows per window. A limit of
    zero or less means no turn (null); rows without a group or a limit have
    their turn at once (slot 0, no rank). A hot group is cut by urgency and
    minute, which rise with the order, so no task sorts a whole group.
    """
    limited = F.col(GROUP).isNotNull() & F.col(LIMIT).isNotNull()
    bound = quota_bound(backlog).withColumn("__less", -F.coalesce(F.col("urgency_score"), F.lit(0.0)))
    chunk = F.struct(F.col("__less"), time_chunk("execute_at").alias("minute"))
    ranked = number_rows(bound, [GROUP], ["__less", "execute_at", "task_id"], chunk, "queue_rank", hot_rows=hot_rows, rest=F.lit(None)).drop("__less")
    free = backlog.filter(~limited).withColumn("queue_rank", F.lit(None).cast("bigint"))
    limit = F.col(LIMIT).cast("bigint")
    turn = F.call_function("div", F.col("queue_rank") - 1, F.greatest(limit, F.lit(1).cast("bigint")))
    return (
        ranked.unionByName(free)
        .withColumn("slot", F.when(~limited, F.lit(0).cast("bigint")).when(limit > 0, turn))
        .withColumn("planned_time", plus_seconds(instant(as_of), F.col("slot") * window))
        .select(*backlog.columns, "queue_rank", "slot", "planned_time")
    )

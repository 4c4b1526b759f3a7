"""Starting anchors of slices, found in two levels, against a plain walk (no Spark involved)."""

from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from joblog.operators import quota

GROUP = quota.GROUP


def batches(columns: dict[str, list], size: int):
    table = pa.table(
        {name: pa.array(values, pa.string() if name == GROUP else pa.int64()) for name, values in columns.items()}
    )
    yield from table.to_batches(max_chunksize=size)


def rows(stream) -> list[tuple]:
    return [row for batch in stream for row in zip(*(c.to_pylist() for c in batch.columns))]


def entries(stamps: dict[str, list[int]], width: int, per_slice: int, per_stretch: int, size: int) -> set[tuple]:
    span = width * per_slice
    ordered = sorted((g, t // span, t) for g, own in stamps.items() for t in own)
    columns = dict(zip((GROUP, "__slice", "__ts"), map(list, zip(*ordered))))
    reports = sorted(rows(quota._anchor_reports(width, span)(batches(columns, size))))
    names = (GROUP, "__stretch", "__slice", "__upto", "__leave")
    columns = dict(zip(names, map(list, zip(*((g, s // per_stretch, s, u, v) for g, s, u, v in reports)))))
    stretches = sorted(rows(quota._combine_reports(width)(batches(columns, size))))
    columns = dict(zip((GROUP, "__slice", "__upto", "__leave"), map(list, zip(*stretches))))
    starts = rows(quota._follow_reports(width, [GROUP], False)(batches(columns, size)))
    mixed = [(g, s // per_stretch, s, u, v, None) for g, s, u, v in reports]
    mixed += [(g, s, None, None, None, e) for g, s, e in starts]
    mixed.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[3] or 0))
    columns = dict(zip((*names, "__entry"), map(list, zip(*mixed))))
    return set(rows(quota._follow_reports(width, [GROUP, "__stretch"], True)(batches(columns, size))))


def expected(stamps: dict[str, list[int]], width: int, per_slice: int) -> set[tuple]:
    span, out = width * per_slice, set()
    for group, own in stamps.items():
        anchor = None
        for t in sorted(own):
            before = anchor
            if anchor is None or t - anchor >= width:
                anchor = t
            if before is not None and before // span < t // span and not any(
                u // span == t // span and u < t for u in own
            ):
                out.add((group, t // span, before))
    return out


TIMES = st.lists(st.integers(-300, 900), min_size=1, max_size=120)


@settings(max_examples=1500, deadline=None)
@given(
    st.dictionaries(st.sampled_from(["g", "h"]), TIMES, min_size=1),
    st.integers(1, 40),
    st.integers(1, 5),
    st.integers(1, 4),
    st.integers(1, 30),
)
def test_entries(stamps, width, per_slice, per_stretch, size):
    assert entries(stamps, width, per_slice, per_stretch, size) == expected(stamps, width, per_slice)

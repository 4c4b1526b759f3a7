"""Structured Streaming forms of the operators."""

from joblog.streaming.intake import stream_messages, stream_progress, stream_stats
from joblog.streaming.keyed import keyed_dedupe, keyed_quota, keyed_timeouts, wall_clock
from joblog.streaming.latest import compact_latest, read_latest, remove_merged, stream_latest
from joblog.streaming.stateful import held_outcomes, read_decided, stream_dedupe, stream_orphans, stream_quota, stream_timeouts
from joblog.streaming.ticks import due_batch, stream_due

__all__ = [
    "compact_latest",
    "due_batch",
    "held_outcomes",
    "keyed_dedupe",
    "keyed_quota",
    "keyed_timeouts",
    "read_decided",
    "read_latest",
    "remove_merged",
    "stream_dedupe",
    "stream_due",
    "stream_latest",
    "stream_messages",
    "stream_orphans",
    "stream_progress",
    "stream_quota",
    "stream_stats",
    "stream_timeouts",
    "wall_clock",
]

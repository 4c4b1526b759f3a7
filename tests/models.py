"""Small sequential models: what the operators must equal, one row at a time."""

from __future__ import annotations


def dedupe(events):
    """events: (seq, key, kind); returns {seq: accepted} for enqueues."""
    active, out = set(), {}
    for seq, key, kind in sorted(events):
        if kind != "enqueue":
            active.discard(key)
        elif key is None:
            out[seq] = True
        else:
            out[seq] = key not in active
            active.add(key)
    return out


def quota(requests, width):
    """requests: (ts, seq, group, limit); returns {seq: (admitted, start, count)}."""
    windows, out = {}, {}
    for ts, seq, group, limit in sorted(requests, key=lambda r: (r[0], r[1])):
        start, count = windows.get(group, (ts, 0))
        if ts - start >= width:
            start, count = ts, 0
        allow = count < limit
        count += allow
        windows[group] = (start, count)
        out[seq] = (allow, start, count)
    return out


def rolling(requests, width):
    recent, out = {}, {}
    for ts, seq, group, limit in sorted(requests, key=lambda r: (r[0], r[1])):
        kept = [t for t in recent.get(group, []) if ts - t < width]
        allow = len(kept) < limit
        recent[group] = kept + [ts] if allow else kept
        out[seq] = allow
    return out


def admit_due(rows, prior):
    """rows: (task_id, group, limit, urgency, execute_at); prior: {group: count}."""
    counts, out = dict(prior), {}
    for task, group, limit, urgency, at in sorted(rows, key=lambda r: (-(r[3] or 0.0), r[4], r[0])):
        if group is None or limit is None:
            out[task] = True
            continue
        out[task] = counts.get(group, 0) < limit
        counts[group] = counts.get(group, 0) + out[task]
    return out


def attempts_of(attempts, max_retries):
    """attempts: ordered (ok, error); returns (attempts, failures, last error, outcome)."""
    last, failures = None, 0
    for n, (ok, error) in enumerate(attempts, 1):
        if ok:
            return n, failures, last, "succeeded"
        failures, last = failures + 1, error
        if n >= max(max_retries, 1):
            return n, failures, last, "dead"
    return failures, failures, last, "pending"


def numbers(attempts):
    """attempts: ordered restart flags; returns attempt numbers."""
    out, n = [], 0
    for restart in attempts:
        n += 1
        out.append(n)
        n = 0 if restart else n
    return out


def pair(executions, results):
    """(id, ts, deadline) and (id, ts) of one task: {result: execution}, ids that timed out."""
    pending, matched = None, {}
    events = sorted([(ts, 0, i, d) for i, ts, d in executions] + [(ts, 1, i, None) for i, ts in results])
    for ts, kind, number, deadline in events:
        if kind == 0:
            pending = (number, deadline)
        else:
            if pending and (pending[1] is None or ts <= pending[1]):
                matched[number] = pending[0]
            pending = None
    late = {i for i, ts, d in executions if d is not None and not any(ts <= r <= d for _, r in results)}
    return matched, late


def attempts(tasks, history, next_tick):
    """tasks: {id: (retry_count, max_retries, cron)}; history: (id, ts, ok, error) in order.

    Returns {id: (transition, attempts, retry_count, execute_at, retried_at, ended_at, error)} of tasks with attempts.
    """
    out = {}
    for task, ts, ok, error in history:
        if task not in tasks:
            continue
        count, most, cron = tasks[task]
        old = out.get(task, (None, 0, count, "own", "own", None, "own"))
        kind, n, count, runs_at, retried, ended, seen = old
        if kind in ("completed", "dead"):
            continue
        tick = next_tick(cron, ts) if ok and cron else None
        if tick is not None:
            out[task] = ("rescheduled", n + 1, 0, tick, retried, None, None)
        elif ok:
            out[task] = ("completed", n + 1, count, runs_at, retried, ts, seen)
        elif count < most - 1:
            out[task] = ("retry", n + 1, count + 1, runs_at, ts, None, error)
        else:
            out[task] = ("dead", n + 1, count, runs_at, retried, ts, seen)
    return out

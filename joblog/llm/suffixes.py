"""Suffix arrays of many small texts at once, by linear grouping."""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Grouping:
    """Suffixes of several instances, grouped by their longest Lyndon prefix and then put in order.

    ``text`` holds the instances one after the other, symbols above 0; a 0
    starts every instance, ends it, and separates its strings. Zeros count as
    different symbols, in order of place. All instances go in step: in each
    step everyone handles its highest group not handled yet. The number of
    steps is the largest number of groups in an instance; the work over all
    steps is linear, up to sorting the few suffixes that move.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray):
        n = len(text)
        self.text, self.starts, self.ends = text, starts, np.append(starts[1:], n)
        instance = np.repeat(np.arange(len(starts)), self.ends - starts)
        self.order = np.lexsort((np.arange(n), text, instance))  # suffixes by group; a group is a range of it
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        sorted_text = text[self.order]
        first = np.concatenate(([True], (sorted_text[1:] != sorted_text[:-1]) | (instance[1:] != instance[:-1])))
        heads = np.flatnonzero(first)
        self.end = np.zeros(n + 1, np.int64)  # by first place of a group
        self.end[heads] = np.append(heads[1:], n)
        self.group = np.empty(n, np.int64)  # first place of the group of a suffix
        self.group[self.order] = np.repeat(heads, np.diff(np.append(heads, n)))
        self.before = np.full(n, -1, np.int64)  # previous suffix in a lower group
        self.after = np.full(n, -1, np.int64)  # next suffix in a lower or the same group: the Lyndon prefix ends there
        self._group_all()
        zero, open_ = np.flatnonzero(text == 0), np.flatnonzero((self.after < 0) & (text > 0))
        self.after[open_] = zero[np.searchsorted(zero, open_)]

    def _group_all(self) -> None:
        zeros = self.end[self.starts]  # where the group of zeros ends
        top = self.ends.copy()
        live = np.flatnonzero(top > zeros)
        marked = np.zeros(len(self.text), bool)
        while len(live):
            low = self.group[self.order[top[live] - 1]]
            members = self.order[_ranges(low, top[live])]
            own = self.group[members]
            at = members - 1
            above = np.flatnonzero(self.group[at] > own)
            while len(above):  # handled groups know their pointers; what is passed over ends here
                self.after[at[above]] = members[above]
                at[above] = self.before[at[above]]
                above = above[self.group[at[above]] > own[above]]
            same = np.flatnonzero(self.group[at] == own)
            self.before[members] = at
            self.after[at[same]] = members[same]
            while len(same):  # pointers inside the group are followed by doubling
                at[same] = self.before[at[same]]
                self.before[members[same]] = at[same]
                same = same[self.group[at[same]] == own[same]]
            self._move(at[self.text[at] > 0], marked)
            top[live] = low
            live = live[top[live] > zeros[live]]

    def _move(self, targets: np.ndarray, marked: np.ndarray) -> None:
        """Suffixes that are pointed to leave their group for new ones right above it, by how often they are."""
        if not len(targets):
            return
        moved, times = np.unique(targets, return_counts=True)
        old = self.group[moved]
        by = np.lexsort((times, old))
        moved, times, old = moved[by], times[by], old[by]
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        heads = np.flatnonzero(new_old)
        sizes = np.diff(np.append(heads, len(old)))
        tails = self.end[old[heads]] - sizes
        slots = _ranges(tails, tails + sizes)
        marked[moved] = True
        inside = self.order[slots]
        displaced = inside[~marked[inside]]
        was = self.place[moved]
        vacated = was[was < np.repeat(tails, sizes)]
        marked[moved] = False
        self.order[vacated], self.place[displaced] = displaced, vacated
        self.order[slots], self.place[moved] = moved, slots
        self.end[old[heads]] = tails
        sub = np.flatnonzero(new_old | np.concatenate(([True], times[1:] != times[:-1])))
        self.group[moved] = np.repeat(slots[sub], np.diff(np.append(sub, len(moved))))
        self.end[slots[sub]] = slots[np.append(sub[1:], len(moved)) - 1] + 1

    def suffix_array(self) -> np.ndarray:
        """Suffixes in order, instance by instance.

        A suffix is its Lyndon prefix, repeated as often as the next smaller
        suffix is in the same group, and then a suffix of a lower group. So a
        group is in order as soon as these lower suffixes are: by number of
        repeats, then by their rank. Groups become ready in rounds.
        """
        n = len(self.text)
        rank = np.full(n, -1, np.int64)
        live = np.flatnonzero(self.text > 0)
        zero = np.flatnonzero(self.text == 0)
        rank[zero] = self.place[zero]  # zeros are sorted by place already
        exit_, repeats = self.after.copy(), np.ones(n, np.int64)
        inner = live[self.group[exit_[live]] == self.group[live]]
        while len(inner):
            repeats[inner] += repeats[exit_[inner]]
            exit_[inner] = exit_[exit_[inner]]
            inner = inner[self.group[exit_[inner]] == self.group[inner]]
        alone = live[self.end[self.group[live]] - self.group[live] == 1]
        rank[alone] = self.group[alone]
        live = live[rank[live] < 0]
        live = live[np.argsort(self.group[live], kind="stable")]
        while len(live):
            head = np.flatnonzero(np.concatenate(([True], self.group[live[1:]] != self.group[live[:-1]])))
            ready = np.logical_and.reduceat(rank[exit_[live]] >= 0, head)
            now = np.repeat(ready, np.diff(np.append(head, len(live))))
            some = live[now]
            order = np.lexsort((rank[exit_[some]], repeats[some], self.group[some]))
            rank[some[order]] = _ranges(self.group[live[head[ready]]], self.end[self.group[live[head[ready]]]])
            live = live[~now]
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
        return out

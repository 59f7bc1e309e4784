"""Order-dependent reductions over one ordered group, written once for batches and streams."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable


def greedy_batches(sizes: Iterable[int], max_items: int, max_chars: int) -> list[int]:
    """The batch of each item: a batch ends before it would hold too many items or characters; an oversize item stands alone."""
    if max_items <= 0 or max_chars <= 0:
        raise ValueError("batch limits must be greater than 0")
    out, batch, items, chars = [], 0, 0, 0
    for size in sizes:
        if items and (items >= max_items or chars + size > max_chars):
            batch, items, chars = batch + 1, 0, 0
        items, chars = items + 1, chars + size
        out.append(batch)
    return out


def anchor_clusters(values: Iterable[float], gap: float) -> list[float]:
    """Anchors of sorted values: a value more than `gap` from the last anchor becomes the next."""
    out: list[float] = []
    for v in sorted(values):
        if not out or abs(v - out[-1]) > gap:
            out.append(v)
    return out


def row_groups(centers: Iterable[float], near: float = 2.5) -> list[int]:
    """The row of each value in rising order: the first row whose median so far is within `near`, or a new one."""
    rows: list[list[float]] = []
    out = []
    for c in centers:
        for i, row in enumerate(rows):
            k = len(row)
            middle = (row[(k - 1) // 2] + row[k // 2]) / 2
            if abs(c - middle) <= near:
                row.append(c)
                out.append(i)
                break
        else:
            rows.append([c])
            out.append(len(rows) - 1)
    return out


def coalesce_runs(runs: Iterable[tuple[float, float, float, float]], level: float = 1.5, back: float = -0.5, gap: float = 2.5) -> list[tuple[float, float, float, float]]:
    """Boxes in order, of which neighbours at one height with a small gap grow into one; the grown box is what the next is held against."""
    out: list[tuple[float, float, float, float]] = []
    for r in runs:
        if out:
            p = out[-1]
            if abs((r[1] + r[3]) / 2 - (p[1] + p[3]) / 2) <= level and back <= r[0] - p[2] <= gap:
                out[-1] = (min(p[0], r[0]), min(p[1], r[1]), max(p[2], r[2]), max(p[3], r[3]))
                continue
        out.append(r)
    return out


class SlidingLog:
    """Limits on accepted requests within windows of seconds. A request is tested against each window in turn; one that is
    rejected isn't recorded. An entry as old as its window has expired."""

    def __init__(self, limits: list[tuple[float, int]], kept: list[list[float]] | None = None):
        self.limits = limits
        self.kept = [deque(k) for k in kept] if kept else [deque() for _ in limits]

    def offer(self, now: float) -> tuple[bool, int]:
        """(allowed, seconds to wait)."""
        for (window, _), kept in zip(self.limits, self.kept):
            while kept and kept[0] <= now - window:
                kept.popleft()
        for (window, most), kept in zip(self.limits, self.kept):
            if len(kept) >= most:
                return False, max(int(window - (now - kept[0])) + 1, 1)
        for kept in self.kept:
            kept.append(now)
        return True, 0


class Progress:
    """Samples (time, share) in order of time: those a step beyond the last report, and the end, are reported with the seconds
    left. The rate is smoothed, 0.65 old and 0.35 new; without one the average counts."""

    def __init__(self, step: float = 0.01):
        self.step, self.last, self.rate, self.begun, self.sample = step, 0.0, 0.0, None, (0.0, 0.0)

    def offer(self, now: float, share: float) -> list[tuple[float, float, int]]:
        if self.begun is None:
            self.begun, self.sample = now, (0.0, now)
        share = max(0.0, min(1.0, share))
        if share - self.last < self.step and share < 1.0:
            return []
        self.last, left = share, 0
        if 0.0 < share < 1.0:
            gained, spent = share - self.sample[0], max(0.0, now - self.sample[1])
            if gained > 0 and spent >= 0.5:
                self.rate = gained / spent if self.rate <= 0 else self.rate * 0.65 + gained / spent * 0.35
                self.sample = (share, now)
            speed = self.rate if self.rate > 0 else (share / (now - self.begun) if now > self.begun else 0.0)
            left = max(0, math.floor((1 - share) / speed)) if speed > 0 else 0
        return [(now, share, left)]

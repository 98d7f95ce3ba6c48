"""Suffix arrays by Larsson and Sadakane's refinement, and Kasai's common prefixes, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Start positions in suffix order.

    Ranks double their depth in each round; suffixes whose rank is already unique
    leave the work, so later rounds touch the repeated parts only.
    """
    n = len(codes)
    first = codes.astype(np.int64)
    packed, got = np.zeros(n, np.int64), 0
    base = int(first.max()) + 2 if n else 2
    while base ** (got + 1) < 1 << 62 and got < max(1, n):  # as many leading codes as fit one integer
        packed = packed * base
        packed[: n - got] += first[got:] + 1
        got += 1
    order = np.argsort(packed)
    group = np.concatenate([[0], np.flatnonzero(packed[order][1:] != packed[order][:-1]) + 1]) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    sizes = np.diff(np.append(group, n))
    rank[order] = np.repeat(group, sizes)
    open_slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    while len(open_slots):
        at = order[open_slots]
        after = np.where(at + got < n, rank[np.minimum(at + got, n - 1)] + 1, 0)
        own = rank[at]
        by = np.argsort(own * (n + 1) + after)
        at, own, after = at[by], own[by], after[by]
        order[open_slots] = at
        fresh = np.append(True, (own[1:] != own[:-1]) | (after[1:] != after[:-1]))
        new = open_slots[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        rank[at] = new
        alone = fresh & np.append(fresh[1:], True)
        open_slots = open_slots[~alone]
        got *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, of the prefix that each suffix shares with the one before it.

    Kasai's bound (a position's value is at least its predecessor's less one) is used
    for all positions at once: values are found for every ``step``-th position and then
    refined between, where the bound and the depth leave anything open.
    """
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    value = np.full(n, -1, np.int64)
    value[before < 0] = 0
    step = 64
    while step >= 1:
        at = np.arange(0, n, step)
        at = at[value[at] < 0]
        if len(at):
            low = np.zeros(len(at), np.int64)
            left = at - at % (2 * step) if step < 64 else at  # the nearest position known from the round before
            low = np.where(left < at, np.maximum(0, value[left] - (at - left)), 0)
            value[at] = extended(codes, at, before[at], low, depth)
        step //= 2
    out = np.zeros(n, np.int64)
    out[:] = value[order]
    return out


def extended(codes: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, known to be ``low`` at least."""
    n, value = len(codes), low.copy()
    live = np.arange(len(a))
    live = live[value < depth]
    width = 8
    while len(live):
        at = value[live]
        x, y = a[live] + at, b[live] + at
        room = np.minimum(np.minimum(n - x, n - y), np.minimum(width, depth - at))
        span = np.arange(width)
        inside = span < room[:, None]
        same = (codes[np.minimum(x[:, None] + span, n - 1)] == codes[np.minimum(y[:, None] + span, n - 1)]) & inside
        run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        value[live] += run
        live = live[(run == width) & (value[live] < depth)]
        width = min(width * 2, 128)
    return value

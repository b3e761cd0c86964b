"""Suffix arrays in numpy, for the texts of one shard."""

from __future__ import annotations

import numpy as np


def larsson_sadakane(first: np.ndarray, step: int, depth: int) -> np.ndarray:
    """The suffix array of a sequence, sorted by at least ``depth`` leading symbols.

    first[i] packs the first ``step`` symbols of suffix i so that their order is kept. Larsson and Sadakane's
    refinement: a group of suffixes that agree on h symbols is sorted by the group of each suffix h further on, so
    that it agrees on 2h; groups of one are left alone. Each round handles all open groups in one sort.
    """
    n = len(first)
    sa = np.argsort(first)
    if n == 0:
        return sa
    key = first[sa]
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(key[1:], key[:-1], out=head[1:])
    group = np.empty(n, np.int64)  # by suffix: where its group starts in the array
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(head, at, 0))
    group[sa] = start
    single = head & np.r_[head[1:], True]
    open_at = at[~single]
    h = step
    while h < depth and len(open_at):
        suffix = sa[open_at]
        ahead = suffix + h
        key = np.where(ahead < n, group[np.minimum(ahead, n - 1)] + 1, 0)
        key += group[suffix] * (n + 1)
        order = np.argsort(key)
        key, suffix = key[order], suffix[order]
        sa[open_at] = suffix
        head = np.empty(len(key), bool)
        head[0] = True
        np.not_equal(key[1:], key[:-1], out=head[1:])
        start = open_at[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        group[suffix] = start
        open_at = open_at[~(head & np.r_[head[1:], True])]
        h *= 2
    return sa


def pack_bytes(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as a number in their order; zeros stand beyond the end."""
    if len(text) == 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([text, np.zeros(7, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(">u8").ravel().astype(np.uint64)


LANE = 256
BYTES = np.array([1 << (8 * i) for i in range(1, 8)], np.uint64)


def kasai(packed: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """By text position: how many bytes its suffix shares with the one before it in the array, ``cap`` at most.

    Kasai's rule, that the next suffix shares at least one byte less, runs along lanes of 256 positions, all lanes
    at once; bytes are compared by eights. The array must be sorted to the end: were suffixes with
    many common bytes left in any order, the rule would not hold for the ones after them.
    """
    n = len(sa)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    if n:
        before[sa[0]] = -1
    wide = np.concatenate([packed, np.zeros(cap + 8, np.uint64)])
    # behind the end of the text everything differs, for the shorter suffix ends there
    out = np.zeros(n, np.int32)
    base = np.arange(0, n, LANE)
    h = np.zeros(len(base), np.int64)
    for s in range(min(LANE, n)):
        if base[-1] + s >= n:
            base, h = base[:-1], h[:-1]
        i = base + s
        j = before[i]
        np.maximum(h - 1, 0, out=h)
        h[j < 0] = 0
        act = np.flatnonzero((j >= 0) & (h < cap))
        while len(act):
            x = wide[i[act] + h[act]] ^ wide[j[act] + h[act]]
            same = x == 0
            differ = ~same
            if differ.any():
                h[act[differ]] += 7 - np.searchsorted(BYTES, x[differ], side="right")
            act = act[same]
            h[act] += 8
            act = act[h[act] < cap]
        out[i] = np.minimum(np.minimum(h, cap), n - np.maximum(i, j))
        h = np.minimum(h, cap)
    return out


def narrow(sequence: np.ndarray, sa: np.ndarray, symbol: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray):
    """Binary search: of the suffixes in sa[low:high], which agree on ``depth`` symbols, those that go on with ``symbol``.
    ``sequence`` must be padded by ``depth`` + 1 symbols that are searched for nowhere."""

    def bound(less) -> np.ndarray:
        a, b = low.copy(), high.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            up = less(sequence[sa[mid] + depth], symbol[todo])
            a[todo[up]] = mid[up] + 1
            b[todo[~up]] = mid[~up]
            todo = todo[a[todo] < b[todo]]
        return a

    return bound(np.less), bound(np.less_equal)

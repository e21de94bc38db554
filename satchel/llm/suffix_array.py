"""Suffix arrays by induced sorting, and permuted common prefixes, with array operations.

Induced sorting scans the array once in each direction and places predecessors of suffixes already in place. Here the scan
advances by stretches: a stretch ends before the first slot that one of its own entries fills, so a whole stretch is read
and its predecessors are placed at once. The work is linear; a stretch holds some sqrt(n) entries on ordinary texts.
"""

from __future__ import annotations

import numpy as np


def _induce(text: np.ndarray, sa: np.ndarray, kind: np.ndarray, heads: np.ndarray, up: bool) -> None:
    """Place the predecessors of one kind: larger ones (kind False) in a scan up from the bucket heads, or smaller ones
    (kind True) in a scan down from the ends."""
    n, i = len(sa), 0
    stretch = 1 << 10
    # a scan down is a scan up of the array read backwards
    view = sa if up else sa[::-1]
    nxt = heads.copy() if up else n - 1 - heads
    while i < n:
        j = min(i + stretch, n)
        p = view[i:j] - 1
        ok = np.flatnonzero(p >= 0)
        ok = ok[kind[p[ok]] != up]
        if not len(ok):
            i = j
            stretch = min(stretch * 2, 1 << 16)
            continue
        c = text[p[ok]]
        end = int(min(j, nxt[c].min()))
        if end < j:
            m = np.searchsorted(ok, end - i)
            ok, c = ok[:m], c[:m]
            stretch = max(64, 2 * (end - i))
        else:
            stretch = min(stretch * 2, 1 << 16)
        if len(ok):
            order = np.argsort(c, kind="stable")
            cs = c[order]
            at = np.flatnonzero(np.append(True, cs[1:] != cs[:-1]))
            num = np.diff(np.append(at, len(cs)))
            view[nxt[cs] + np.arange(len(cs)) - np.repeat(at, num)] = p[ok[order]]
            nxt[cs[at]] += num
        i = max(end, i + 1)


def suffix_array(text: np.ndarray, size: int | None = None) -> np.ndarray:
    """The suffix array of text (integers of at least 0), of which the last must be 0 and the only 0."""
    n = len(text)
    text = text.astype(np.int64, copy=False)
    size = int(text.max()) + 1 if size is None else size
    if n == 1:
        return np.zeros(1, np.int64)
    # classes: True where a suffix is smaller than the next one
    step = np.sign(np.diff(text))
    change = np.append(np.flatnonzero(step), n - 1)
    kind = np.ones(n, bool)
    kind[:-1] = np.append(step, -1)[change[np.searchsorted(change, np.arange(n - 1))]] > 0
    least = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1  # leftmost smaller ones
    total = np.cumsum(np.bincount(text, minlength=size))
    heads, tails = np.append(0, total[:-1]), total - 1

    def fill(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        c = text[order]
        by = np.argsort(c, kind="stable")
        cs = c[by]
        last = np.append(np.flatnonzero(cs[1:] != cs[:-1]), len(cs) - 1)
        num = np.diff(np.append(-1, last))
        sa[tails[cs] - (np.repeat(last, num) - np.arange(len(cs)))] = order[by]
        _induce(text, sa, kind, heads, True)
        keep = np.flatnonzero(kind[sa] & (sa >= 0))
        sa[keep] = -1  # the smaller ones are placed anew
        sa[0] = n - 1
        _induce(text, sa, kind, tails, False)
        return sa

    sa = fill(least)
    is_least = np.zeros(n, bool)
    is_least[least] = True
    order = sa[is_least[sa]]
    # name the leftmost-smaller substrings in their order; equal ones get one name
    ends = np.append(least[1:], n - 1)
    length = np.zeros(n, np.int64)
    length[least] = ends - least + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        equal = text[x] == text[y]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
        live = live[length[a[live]] > k]
    names = np.append(0, np.cumsum(~same))
    if names[-1] + 1 < len(order):
        of = np.empty(n, np.int64)
        of[order] = names
        order = least[suffix_array(of[least], int(names[-1]) + 1)]
    return fill(order)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: the length of the common prefix of suffixes sa[i-1] and sa[i]; 0 at 0.

    By permuted common prefixes: in text order a value falls by at most one, and by exactly one unless the characters before
    the suffix and its neighbour differ; only values where they differ are counted out."""
    n = len(sa)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    first = np.ones(n, bool)
    first[1:] = (before[1:] <= 0) | (text[at[1:] - 1] != text[np.maximum(before[1:] - 1, 0)])
    own = np.flatnonzero(first)
    length = np.zeros(n, np.int64)
    live = own[before[own] >= 0]
    k = 0
    while len(live):
        x, y = live + k, before[live] + k
        ok = (x < n) & (y < n)
        live, x, y = live[ok], x[ok], y[ok]
        live = live[text[x] == text[y]]
        k += 1
        length[live] = k
    start = np.maximum.accumulate(np.where(first, at, 0))
    plcp = np.maximum(length[start] - (at - start), 0)
    lcp = plcp[sa]
    lcp[0] = 0
    return lcp

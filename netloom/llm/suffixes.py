"""Suffix arrays of bytes by induced sorting, the order of the strings it starts from by doubling, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def types_of(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the last is larger than the empty suffix (L)."""
    n = len(t)
    sign = np.empty(n, "i1")
    sign[:-1] = np.sign(t[1:].astype("i8") - t[:-1])
    sign[-1] = -1
    known = np.where(sign != 0, np.arange(n), n)
    return sign[np.minimum.accumulate(known[::-1])[::-1]] > 0


def leftmost_smaller(small: np.ndarray) -> np.ndarray:
    """Positions of S suffixes that follow an L suffix."""
    return np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _spread(sa: np.ndarray, into: np.ndarray, keys: np.ndarray, items: np.ndarray, step: int) -> None:
    """Append items to their keys' buckets, in order; ``into`` holds each bucket's next place."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    n = np.diff(np.append(first, len(k)))
    rank = np.arange(len(k)) - np.repeat(first, n)
    sa[into[k] + step * rank] = items[order]
    into[k[first]] += step * n


def _induce_bytes(t: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """Suffix order from the order of leftmost-smaller suffixes, a bucket at a time."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    end = np.cumsum(count)
    head = end - count
    sa = np.full(n, -1, "i8")
    stars = {}
    key = t[lms]
    order = np.argsort(key, kind="stable")
    bound = np.searchsorted(key[order], np.arange(sigma + 1))
    for c in range(sigma):
        if bound[c] < bound[c + 1]:
            stars[c] = lms[order[bound[c] : bound[c + 1]]]
    larger = ~small
    # L suffixes, from small to large first letters
    into = head.copy()
    sa[into[t[n - 1]]] = n - 1
    into[t[n - 1]] += 1
    for c in np.flatnonzero(count):
        lo = done = head[c]
        while done < into[c]:  # those that this bucket adds to itself
            j = sa[done : into[c]] - 1
            done = into[c]
            j = j[(j >= 0)]
            j = j[larger[j] & (t[j] == c)]
            sa[into[c] : into[c] + len(j)] = j
            into[c] += len(j)
        j = sa[lo : into[c]]
        if c in stars:
            j = np.concatenate([j, stars[c]])
        j = j[j > 0] - 1
        j = j[larger[j] & (t[j] > c)]
        if len(j):
            _spread(sa, into, t[j], j, 1)
    last_l = into.copy()
    # S suffixes, from large to small first letters
    into = end - 1
    for c in np.flatnonzero(count)[::-1]:
        done = end[c] - 1
        while done > into[c]:
            j = sa[into[c] + 1 : done + 1][::-1] - 1
            done = into[c]
            j = j[j >= 0]
            j = j[small[j] & (t[j] == c)]
            sa[into[c] - len(j) + 1 : into[c] + 1] = j[::-1]
            into[c] -= len(j)
        j = np.concatenate([sa[into[c] + 1 : end[c]][::-1], sa[head[c] : last_l[c]][::-1]])
        j = j[j > 0] - 1
        j = j[small[j] & (t[j] < c)]
        if len(j):
            _spread(sa, into, t[j], j, -1)
    return sa


def _by_doubling(t: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``t`` over any alphabet: each round sorts by twice as many letters those that are still equal."""
    n = len(t)
    sa = np.argsort(t, kind="stable")
    rank = np.empty(n, "i8")  # the first place of those equal so far
    at, items, key, h = np.arange(n), sa, t[sa], 0
    while True:
        first = np.concatenate([[True], key[1:] != key[:-1], [True]])
        rank[items] = at[np.maximum.accumulate(np.where(first[:-1], np.arange(len(at)), 0))]
        at = at[~(first[:-1] & first[1:])]
        if not len(at):
            return sa
        h = max(1, 2 * h)
        items = sa[at]
        after = np.where(items + h < n, rank[np.minimum(items + h, n - 1)] + 1, 0)
        key = rank[items] * (n + 1) + after
        order = np.argsort(key)
        items, key = items[order], key[order]
        sa[at] = items


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether t[a : a + length] equals t[b : b + length], pair by pair."""
    same = np.ones(len(a), bool)
    for i in np.flatnonzero(length > 64):
        same[i] = np.array_equal(t[a[i] : a[i] + length[i]], t[b[i] : b[i] + length[i]])
    left, k = np.flatnonzero(length <= 64), 0
    while len(left):
        left = left[length[left] > k]
        ok = t[a[left] + k] == t[b[left] + k]
        same[left[~ok]] = False
        left = left[ok]
        k += 1
    return same


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes of ``t`` (numbers below ``sigma``); a suffix precedes those it begins."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    if sigma > 512:
        return _by_doubling(t)
    small = types_of(t)
    lms = leftmost_smaller(small)
    if len(lms) < 2:
        return _induce_bytes(t, small, sigma, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sa = _induce_bytes(t, small, sigma, lms)
    by_string = sa[is_lms[sa]]
    place = np.full(n, -1, "i8")
    place[lms] = np.arange(len(lms))
    # a leftmost-smaller substring runs to the next such position; the last one runs to the end
    length = np.append(np.diff(lms) + 1, n - lms[-1])
    size = length[place[by_string]]
    a, b = by_string[:-1], by_string[1:]
    last = lms[-1]
    equal = (size[1:] == size[:-1]) & (a != last) & (b != last)
    where = np.flatnonzero(equal)
    equal[where] = _same(t, a[where], b[where], size[where])
    names = np.concatenate([[0], np.cumsum(~equal)])
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), "i8")
        reduced[place[by_string]] = names
        by_string = lms[_by_doubling(reduced)]
    return _induce_bytes(t, small, sigma, by_string)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """PLCP, at most ``most``: for each position, the letters shared with the suffix before it in order.

    Only where the letter before differs from that of the neighbour is a prefix counted;
    everywhere else it is the left position's, less one.
    """
    n = len(t)
    phi = np.full(n, -1, "i8")
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    before = np.where((i > 0) & (phi > 0), t[np.maximum(i - 1, 0)] == t[np.maximum(phi - 1, 0)], False)
    start = np.flatnonzero(~before)
    a, b = start[phi[start] >= 0], phi[start[phi[start] >= 0]]
    padded = np.concatenate([t.astype("u1"), np.zeros(8, "u1")]) if t.max(initial=0) < 256 else None
    out = np.zeros(n, "i8")
    length = np.zeros(len(a), "i8")
    live = np.arange(len(a))
    if padded is not None:  # eight letters at a time
        words = np.ndarray((n + 1,), "<u8", padded.tobytes(), strides=(1,))
        while len(live):
            x, y = a[live] + length[live], b[live] + length[live]
            ok = (np.maximum(x, y) + 8 <= n)
            live, x, y = live[ok], x[ok], y[ok]
            live = live[words[x] == words[y]]
            length[live] += 8
        live = np.arange(len(a))
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        ok = (np.maximum(x, y) < n)
        live, x, y = live[ok], x[ok], y[ok]
        live = live[t[x] == t[y]]
        length[live] += 1
    out[a] = length
    anchor = np.maximum.accumulate(np.where(~before, i, 0))
    return np.minimum(np.maximum(out[anchor] - (i - anchor), 0), most)

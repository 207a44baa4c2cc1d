"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are classified; the leftmost smaller ones (LMS) are sorted by their substrings, which are sorted by
inducing, named, and, where names repeat, sorted as a string of names by recursion; the rest is induced from
them in one pass to the right and one to the left. The text itself has few symbols, so its passes go bucket by
bucket in numpy; strings of names have many, and their passes go element by element.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last symbol is the least and stands alone."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        at = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
        out[:-1] = (t[:-1] < t[1:])[np.minimum.accumulate(at[::-1])[::-1]]
    return out


def _lms(small: np.ndarray) -> np.ndarray:
    out = np.zeros(len(small), bool)
    out[1:] = small[1:] & ~small[:-1]
    return out


def _induce(t: np.ndarray, small: np.ndarray, order: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in theirs; t has few symbols."""
    counts = np.bincount(t, minlength=symbols)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(t), -1, np.int32)
    used = np.flatnonzero(counts)

    def runs(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        by = np.argsort(chars, kind="stable")
        chars = chars[by]
        n = np.bincount(chars, minlength=symbols)
        return by, chars, np.arange(len(by)) - (np.cumsum(n) - n)[chars], n

    by, chars, nth, n = runs(t[order])
    sa[(ends - n)[chars] + nth] = order[by]
    lms_start, head = ends - n, starts.copy()

    def to_right(front: np.ndarray) -> None:
        j = front[front > 0] - 1
        j = j[~small[j]]
        if len(j):
            by, chars, nth, n = runs(t[j])
            sa[head[chars] + nth] = j[by]
            head[:] += n

    for c in used:
        low = starts[c]
        while low < head[c]:  # runs of one symbol lengthen their own bucket
            low, front = head[c], sa[low : head[c]]
            to_right(front)
        to_right(sa[lms_start[c] : ends[c]])
    tail = ends.copy()

    def to_left(front: np.ndarray) -> None:
        j = front[front > 0] - 1
        j = j[small[j]]
        if len(j):
            by, chars, nth, n = runs(t[j])
            sa[tail[chars] - 1 - nth] = j[by]
            tail[:] -= n

    sa[0], tail[t[-1]] = len(t) - 1, tail[t[-1]] - 1
    for c in used[::-1]:
        high = ends[c]
        while tail[c] < high:
            high, front = tail[c], sa[tail[c] : high][::-1]
            to_left(front)
        to_left(sa[starts[c] : head[c]][::-1])
    return sa


def _names(t: np.ndarray, ordered: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each LMS substring, by its rank; ordered: LMS places by substring; places: from left to right."""
    length = np.ones(len(t), np.int32)
    length[places[:-1]] = np.diff(places) + 1
    a, b = ordered[:-1], ordered[1:]
    same = np.flatnonzero(length[a] == length[b])
    k, equal = 0, np.zeros(len(a), bool)
    while len(same):
        same = same[t[a[same] + k] == t[b[same] + k]]
        k += 1
        done = length[a[same]] == k
        equal[same[done]] = True
        same = same[~done]
    name = np.empty(len(t), np.int32)
    name[ordered] = np.concatenate([[0], np.cumsum(~equal)])
    return name[places]


def _sort_names(s: list[int], symbols: int) -> list[int]:
    """The suffix array of a string of names, by the same steps; its last symbol is the least and stands alone."""
    n = len(s)
    t = np.array(s, np.int32)
    small_flags = _types(t)
    lms_flags = _lms(small_flags)
    places = np.flatnonzero(lms_flags)
    counts = np.bincount(t, minlength=symbols)
    end_of = np.cumsum(counts)
    ends, starts = end_of.tolist(), (end_of - counts).tolist()
    # For each suffix, the bucket of the one before it if that is to be induced in this pass, else -1; and -1 for no suffix.
    large_before, small_before = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
    large_before[1:n] = np.where(small_flags[:-1], -1, t[:-1])
    small_before[1:n] = np.where(small_flags[:-1], t[:-1], -1)
    to_right, to_left = large_before.tolist(), small_before.tolist()

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = ends.copy()
        for j in reversed(order):
            tail[s[j]] = at = tail[s[j]] - 1
            sa[at] = j
        head = starts.copy()
        for j in sa:
            c = to_right[j]
            if c >= 0:
                at = head[c]
                sa[at] = j - 1
                head[c] = at + 1
        tail = ends.copy()
        for j in reversed(sa):
            c = to_left[j]
            if c >= 0:
                tail[c] = at = tail[c] - 1
                sa[at] = j - 1
        return sa

    if len(places) == 1:
        return induce(places.tolist())
    ordered = np.array(induce(places.tolist()), np.int32)
    ordered = ordered[lms_flags[ordered]]
    names = _names(t, ordered, places)
    last = int(names.max())
    if last + 1 < len(names):
        order = places[_sort_names(names.tolist(), last + 1)]
    else:
        order = ordered
    return induce(order.tolist())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of bytes, with the empty suffix first."""
    t = np.append(text.astype(np.int16) + 1, np.int16(0))
    small = _types(t)
    is_lms = _lms(small)
    places = np.flatnonzero(is_lms).astype(np.int32)
    if len(places) == 0:
        return np.zeros(1, np.int32)
    order = places
    if len(places) > 1:
        ordered = _induce(t, small, places, 257)
        ordered = ordered[is_lms[ordered]]
        names = _names(t, ordered, places)
        last = int(names.max())
        order = ordered if last + 1 == len(names) else places[_sort_names(names.tolist(), last + 1)]
    return _induce(t, small, order, 257)


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each place the one before it in suffix order, -1 for none; how long a prefix the two share).

    A value follows from its left neighbour's unless the symbols before the two places differ; only those are compared.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]] = np.concatenate([[-1], sa[1:-1]])
    place = np.arange(n)
    has = before >= 0
    fresh = np.ones(n, bool)
    inner = has & (place > 0) & (before > 0)
    fresh[inner] = text[place[inner] - 1] != text[before[inner] - 1]
    padded = np.append(text, np.zeros(16, np.uint8))
    words = np.ndarray((n + 8,), "<u8", padded.tobytes(), 0, (1,))
    shared = np.zeros(n, np.int64)
    at = np.flatnonzero(fresh & has)
    a, b, size = at.copy(), before[at].copy(), np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        x = words[a[live] + size[live]] ^ words[b[live] + size[live]]
        size[live] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
        room = n - np.maximum(a[live], b[live])
        over = size[live] >= room
        size[live[over]] = room[over]
        live = live[(x == 0) & ~over]
    shared[at] = size
    anchor = np.maximum.accumulate(np.where(fresh, place, 0))
    shared = np.maximum(shared[anchor] - (place - anchor), 0)
    shared[~has] = 0
    return before, shared

"""Word shingles as sets of 64-bit hashes, and one-permutation sketches with optimal densification."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Each text's distinct shingles, as sorted hashes.

    Words are runs without ASCII white space, A-Z lower-cased; fewer words than `size` are one shingle, none no shingle.
    """
    words: list[bytes] = []
    ends = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words += text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space alone
        ends[i] = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(0, len(h) - size + 1)
    s = np.zeros(n, np.uint64)
    for k in range(size):
        s = _mix(s + h[k : n + k] * _C[k % len(_C)])
    out, start = [], 0
    for end in ends:
        if end - start >= size:
            out.append(np.unique(s[start : end - size + 1]))
        else:
            short = np.array([end - start], np.uint64)
            for k in range(start, end):
                short = _mix(short + h[k : k + 1] * _C[(k - start) % len(_C)])
            out.append(short if end > start else short[:0])
        start = end
    return out


@cache
def _probe(attempt: int, bins: int) -> np.ndarray:
    """For each bin, where its attempt-th look goes: the same for every set."""
    return (_mix(np.arange(bins, dtype=np.uint64) * _C[1] + np.uint64(attempt * int(_C[0]) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bins)).astype(np.int64)


def sketches(sets: list[np.ndarray], bins: int, deal: int = 0) -> np.ndarray:
    """One row a set: in each bin the least hash that one permutation throws there; `deal` chooses the permutation.

    An empty bin copies a bin that holds something, found by looks that do not depend on the set, so that two
    sets agree in it as often as their similarity says. Rows of empty sets mean nothing.
    """
    counts = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if deal:
        every = _mix(every ^ np.uint64(deal * int(_C[4]) & 0xFFFFFFFFFFFFFFFF))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(len(sets) * bins, none)
    at = np.repeat(np.arange(len(sets)) * bins, counts) + ((every >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sketch, at, _mix(every + _C[2]) >> np.uint64(1))
    sketch = sketch.reshape(len(sets), bins)
    given = sketch.copy()
    row, col = np.nonzero((sketch == none) & (counts > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        look = given[row, _probe(attempt, bins)[col]] if attempt < 4096 else given[row].min(1)
        found = look != none
        sketch[row[found], col[found]] = look[found]
        row, col = row[~found], col[~found]
    return sketch


def band_hashes(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A hash for each band of a sketch, as signed numbers."""
    rows = sketch.shape[1] // bands
    h = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * _C[3]), (len(sketch), bands)).copy()
    for k in range(rows):
        h = _mix(h * _C[0] + sketch[:, k::rows][:, :bands])
    return h.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly; both sorted."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two runs: a merge
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)

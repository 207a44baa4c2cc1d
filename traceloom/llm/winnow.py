"""Anchors of a byte string: every SPAN-byte window is named by the least hash of the GRAM-byte strings in it.

Equal windows have the same anchor at the same place, so only windows of equal anchors can be equal. Neighbouring
windows mostly share their anchor; such a run of windows with the bytes they cover is a segment. In periodic text equal
segments follow each other; they are told as one with its number.
"""

from __future__ import annotations

import numpy as np
import xxhash

SPAN, GRAM = 200, 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 21), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte string of buf."""
    n = len(buf)
    if n < GRAM:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * _power(_INVERSE, n - GRAM + 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _sliding_least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the least of each `width` neighbouring hashes, the first place that has it)."""
    least, place, span = h, np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        later = least[step:] < least[:-step]
        least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
        span += step
    return least, place


def _stretches(texts: list[bytes], most: int):
    """(text, first window, bytes) of the texts, a long one in stretches of `most` windows."""
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - SPAN + 1), most):
            yield k, at, t[at : at + most + SPAN - 1]


def segments(texts: list[bytes], most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text, first window, windows, repeats, anchor hash, digest of the bytes covered by one) of each segment of the texts."""
    made: list[tuple] = []
    held: list[tuple] = []
    size = 0
    for part in _stretches(texts, most):
        if held and size + len(part[2]) > 2 * most:
            made.append(_segments(held))
            held, size = [], 0
        held.append(part)
        size += len(part[2])
    made.append(_segments(held))
    return *(np.concatenate([m[i] for m in made]) for i in range(5)), [d for m in made for d in m[5]]


def _segments(parts: list[tuple[int, int, bytes]]) -> tuple:
    lens = np.array([len(t) for _, _, t in parts], np.int64)
    starts = np.cumsum(lens) - lens
    raw = b"".join(t for _, _, t in parts)
    counts = np.maximum(lens - SPAN + 1, 0)
    if not counts.sum():
        return *(np.zeros(0, np.int64),) * 4, np.zeros(0, np.uint64), []
    least, place = _sliding_least(gram_hashes(np.frombuffer(raw, np.uint8)), SPAN - GRAM + 1)
    owner = np.repeat(np.arange(len(parts)), counts)
    window = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    anchor = place[window]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    runs = np.diff(np.append(first, len(owner)))
    at, who, name = window[first], owner[first], least[window[first]]
    # A segment equal to the one before it: of the same text, anchor and length, and then byte by byte.
    same = np.flatnonzero((who[1:] == who[:-1]) & (name[1:] == name[:-1]) & (runs[1:] == runs[:-1])) + 1
    alike = np.zeros(len(first), bool)
    if len(same):
        view = memoryview(raw)
        alike[same] = [view[b : b + n] == view[a : a + n] for a, b, n in zip(at[same - 1].tolist(), at[same].tolist(), (runs[same] + SPAN - 1).tolist(), strict=True)]
    lead = np.flatnonzero(~alike)
    repeats = np.diff(np.append(lead, len(first)))
    at, who, name, runs = at[lead], who[lead], name[lead], runs[lead]
    digest = xxhash.xxh3_128_digest
    digests = [digest(raw[a:b]) for a, b in zip(at.tolist(), (at + runs + SPAN - 1).tolist(), strict=True)]
    text, offset = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    return text[who], at - starts[who] + offset[who], runs, repeats, name, digests

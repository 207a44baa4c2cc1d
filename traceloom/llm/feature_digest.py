"""Operator 8, document fingerprints by improbable features.

Every WINDOW-byte window of a text has an entropy; how rare its level is among all windows of the corpus is its
rank, rarest first (levels of hardly any or nearly full entropy say nothing and come last). Of each WINDOW
neighbouring windows the leftmost rarest gets a point, and windows with POINTS points are the text's features.
They are hashed in order into Bloom filters of BITS bits, FILL features a filter, HASHES bits a feature; the
chain of filters is the fingerprint. Two filters are compared by the bits they share over what chance would
give, on a scale to 1; a chain's likeness is the mean, over the shorter chain, of each filter's best match.

Defined results: null texts count as empty; an empty text has an empty fingerprint; likeness is 1 between equal
fingerprints and 0 between an empty and another. A text shorter than a window is one feature, one with fewer
than 2 * POINTS windows needs points from half of them. Where no window of a text gets there (constant, periodic
and some other texts), those with the most points are its features, so only an empty text has none. The next document is
the next row by (doc_id, hash of the text), so rows of one doc_id can be dealt to several tasks; a row
without doc_id has no next one (it counts as empty) and is nobody's. A lone document is its own next. A text of over
CHUNK bytes is read in pieces that overlap by what a window's points depend on, with the same features as in one. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import partitions, range_bounds

WINDOW, POINTS = 32, 8
BITS, FILL, HASHES = 2048, 160, 5
LEVELS, LEAST, MOST = 1000, 100, 990
CHANCE_MARGIN = 0.1
CHUNK = 1 << 20
_PHI = np.round(np.array([(m + 1) * np.log2(m + 1) - (m * np.log2(m) if m else 0) for m in range(WINDOW)]) * 4096).astype(np.int64)
_FULL = int(WINDOW * np.log2(WINDOW) * 4096)


def entropy_levels(buf: np.ndarray) -> np.ndarray:
    """The entropy level, 0 to LEVELS, of each window of buf, in whole numbers and so the same in any grouping."""
    n = len(buf)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for at in range(0, n, 1 << 16):  # small enough for the cache
        to = min(n, at + (1 << 16))
        for k in range(1, WINDOW):
            a = max(at, k)
            if a < to:
                same = (buf[a:to] == buf[a - k : to - k]).view(np.uint8)
                back[a:to] += same
                ahead[a - k : to - k] += same
    # From one window to the next, a byte leaves (as often as `ahead` there before) and one enters.
    change = _PHI[back[WINDOW:]] - _PHI[ahead[: n - WINDOW]]
    sums = np.cumsum(np.concatenate([[_PHI[back[:WINDOW]].sum()], change]))
    return (_FULL - sums) * LEVELS // _FULL


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all texts in a row, where each starts, its windows); a text shorter than a window is padded to one."""
    padded = [t if len(t) >= WINDOW or not t else t.ljust(WINDOW, b"\0") for t in texts]
    lens = np.array([len(t) for t in padded], np.int64)
    return np.frombuffer(b"".join(padded), np.uint8), np.cumsum(lens) - lens, np.maximum(lens - WINDOW + 1, 0)


def _pieces(n: int, margin: int):
    """(first window, end, first byte read, end) of stretches of the windows of a text of n bytes; `margin` windows more are read on both sides."""
    for a in range(0, n - WINDOW + 1, CHUNK):
        b = min(n - WINDOW + 1, a + CHUNK)
        yield a, b, max(0, a - margin), min(n, b + margin + WINDOW - 1)


def level_counts(texts: list[bytes]) -> np.ndarray:
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        buf = np.frombuffer(texts[0], np.uint8)
        return sum(np.bincount(entropy_levels(buf[low:high]), minlength=LEVELS + 1) for _, _, low, high in _pieces(len(buf), 0))
    buf, starts, windows = _buffer(texts)
    levels = entropy_levels(buf)
    inside = np.zeros(len(levels) + 1, np.int64)
    np.add.at(inside, starts[windows > 0], 1)
    np.add.at(inside, (starts + windows)[windows > 0], -1)
    return np.bincount(levels[np.cumsum(inside[:-1]) > 0], minlength=LEVELS + 1)


def rarity(counts: np.ndarray) -> np.ndarray:
    """Each level's rank, rarest first."""
    level = np.arange(LEVELS + 1)
    dull = (level < LEAST) | (level > MOST)
    rank = np.empty(LEVELS + 1, np.int64)
    rank[np.lexsort((level, counts, dull))] = level
    return rank


def _select(buf: np.ndarray, starts: np.ndarray, windows: np.ndarray, rank: np.ndarray, always: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the features, the text each belongs to); with `always`, a text no window of which has enough points has those with the most."""
    levels = entropy_levels(buf)
    n = len(levels)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(starts)), windows)
    valid = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(len(owner))
    bits = max(20, n.bit_length())
    key = np.full(n + WINDOW, np.iinfo(np.int64).max, np.int64)
    key[valid] = rank[levels[valid]] << bits | valid
    span = 1
    while span < WINDOW:  # key[i] becomes the least of WINDOW keys; between texts stand WINDOW - 1 windows of none
        np.minimum(key[:-span], key[span:], out=key[:-span])
        span *= 2
    winner = key[valid] & ((1 << bits) - 1)
    points = np.bincount(winner, minlength=n)[valid]
    need = np.clip(windows // 2, 1, POINTS)
    if always:
        some = windows > 0
        need[some] = np.minimum(need[some], np.maximum.reduceat(points, (np.cumsum(windows) - windows)[some]))
    chosen = points >= need[owner]
    return valid[chosen], owner[chosen]


def _hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[at].view("<u8") if len(at) else np.zeros((0, WINDOW // 8), np.uint64)
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(WINDOW // 8):
        h = (h ^ words[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _unique(h: np.ndarray) -> np.ndarray:
    """The first of equal hashes each, in order."""
    return h[np.sort(np.unique(h, return_index=True)[1])]


def _long_hashes(text: bytes, rank: np.ndarray) -> np.ndarray:
    """The hashes of a long text's features in order, piece by piece."""
    buf = np.frombuffer(text, np.uint8)
    found, most = [], 0
    for a, b, low, high in _pieces(len(buf), WINDOW - 1):
        levels = entropy_levels(buf[low:high])
        n = len(levels)
        bits = max(20, n.bit_length())
        key = np.full(n + WINDOW, np.iinfo(np.int64).max, np.int64)
        key[:n] = rank[levels] << bits | np.arange(n)
        span = 1
        while span < WINDOW:
            np.minimum(key[:-span], key[span:], out=key[:-span])
            span *= 2
        points = np.bincount(key[:n] & ((1 << bits) - 1), minlength=n)[a - low : b - low]
        need = min(POINTS, max(most, int(points.max())))
        if need > most:
            found, most = [], need
        found.append(_unique(_hashes(buf, a + np.flatnonzero(points >= most))))
    return _unique(np.concatenate(found))


def digests(texts: list[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(filters as rows of bytes, features in the last one) of each text."""
    if len(texts) == 1 and len(texts[0]) > CHUNK:
        h = _long_hashes(texts[0], rank)
        return _chains(h, np.zeros(len(h), np.int64), 1)
    buf, starts, windows = _buffer(texts)
    at, owner = _select(buf, starts, windows, rank, always=True)
    h = _hashes(buf, at)
    # The first of equal features of a text counts.
    order = np.lexsort((np.arange(len(h)), h, owner))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    keep = np.sort(order[first])
    return _chains(h[keep], owner[keep], len(texts))


def _chains(h: np.ndarray, owner: np.ndarray, texts: int) -> list[tuple[np.ndarray, int]]:
    counts = np.bincount(owner, minlength=texts)
    nth = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    chain = -(-counts // FILL)
    base = np.cumsum(chain) - chain
    bits = np.zeros(int(chain.sum()) * BITS, np.uint8)
    row = (base[owner] + nth // FILL) * BITS
    for k in range(HASHES):
        bits[row + ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    filters = np.packbits(bits).reshape(-1, BITS // 8)
    return [(filters[b : b + c], int(n - (c - 1) * FILL) if n else 0) for b, c, n in zip(base, chain, counts, strict=True)]


def to_text(digest: tuple[np.ndarray, int]) -> str:
    filters, last = digest
    return f"{last}:{base64.b64encode(filters.tobytes()).decode()}" if len(filters) else ""


def from_text(text: str) -> tuple[np.ndarray, int]:
    if not text:
        return np.zeros((0, BITS // 8), np.uint8), 0
    last, _, data = text.partition(":")
    return np.frombuffer(base64.b64decode(data), np.uint8).reshape(-1, BITS // 8), int(last)


def _scores(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Overlap of filters a and b (last axis: bytes) over chance, 0 to 1."""
    most = np.minimum(np.bitwise_count(a).sum(-1, dtype=np.int64), np.bitwise_count(b).sum(-1, dtype=np.int64))
    both = np.bitwise_count(a & b).sum(-1, dtype=np.int64)
    q = 1 - 1 / BITS
    chance = BITS * (1 - q ** (HASHES * na) - q ** (HASHES * nb) + q ** (HASHES * (na + nb)))
    floor = np.minimum(chance + CHANCE_MARGIN * (most - chance), most - 1e-9)
    return np.clip((both - floor) / (most - floor), 0, 1)


def likeness(x: tuple[np.ndarray, int], y: tuple[np.ndarray, int]) -> float:
    """0 to 1, the same in either order."""
    if len(x[0]) == len(y[0]) and x[1] == y[1] and (x[0] == y[0]).all():
        return 1.0
    if not len(x[0]) or not len(y[0]):
        return 0.0
    full = lambda d: np.append(np.full(len(d[0]) - 1, FILL), d[1])
    nx, ny = full(x), full(y)
    best_x, best_y = np.zeros(len(nx)), np.zeros(len(ny))
    for i in range(len(nx)):  # a row at a time: chains of long texts are long
        s = _scores(x[0][i], nx[i], y[0], ny)
        best_x[i] = s.max()
        np.maximum(best_y, s, out=best_y)
    ways = [(best_x, nx)] * (len(nx) <= len(ny)) + [(best_y, ny)] * (len(ny) <= len(nx))
    return float(np.mean([np.average(best, weights=n) for best, n in ways]))


def likenesses(xs: list, ys: list) -> np.ndarray:
    """likeness of each pair; pairs of single filters, which most are, in one go."""
    out = np.empty(len(xs))
    single = np.array([len(x[0]) == 1 == len(y[0]) for x, y in zip(xs, ys, strict=True)], bool)
    at = np.flatnonzero(single)
    if len(at):
        a, b = np.concatenate([xs[i][0] for i in at]), np.concatenate([ys[i][0] for i in at])
        na, nb = np.array([xs[i][1] for i in at]), np.array([ys[i][1] for i in at])
        out[at] = np.where((a == b).all(1) & (na == nb), 1.0, _scores(a, na, b, nb))
    for i in np.flatnonzero(~single):
        out[i] = likeness(xs[i], ys[i])
    return out


def edited(text: str, following: str) -> str:
    """text, its last half replaced by as many of the first code points of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def corpus_rarity(docs: DataFrame) -> np.ndarray:
    """Ranks from the windows of all texts; LEVELS + 1 counts come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(LEVELS + 1, np.int64)
        for pdf in batches:
            texts = [t.encode() for t in pdf["text"]]
            for a, b in _groups([len(t) for t in texts]):
                total += level_counts(texts[a:b])
        yield pd.DataFrame({"level": np.flatnonzero(total), "n": total[total > 0]})

    texts = docs.select("text").filter("text is not null")
    rows = texts.mapInPandas(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS + 1, np.int64)
    for r in rows:
        counts[r["level"]] = r["n"]
    return rarity(counts)


def _groups(sizes: list[int], most: int = CHUNK):
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(pairs: list[tuple], rank: np.ndarray) -> pd.DataFrame:
    """pairs: (doc_id, text, next text)."""
    changed = [edited(t, n).encode() for _, t, n in pairs]
    # A document is the next of the one before it: its digest is made once.
    place: dict[str, int] = {}
    for _, t, n in pairs:
        place.setdefault(t, len(place))
        place.setdefault(n, len(place))
    every = [t.encode() for t in place] + changed
    made: list = []
    for a, b in _groups([len(t) for t in every]):
        made += digests(every[a:b], rank)
    own, new = [made[place[t]] for _, t, _ in pairs], made[len(place) :]
    return pd.DataFrame(
        {
            "doc_id": pd.array([d for d, _, _ in pairs], "Int64"),
            "n_chars": [len(t) for _, t, _ in pairs],
            "edited_sha256": [hashlib.sha256(c).hexdigest() for c in changed],
            "fingerprint": [to_text(d) for d in own],
            "edited_fingerprint": [to_text(d) for d in new],
            "near_edited": likenesses(own, new),
            "near_next": likenesses(own, [made[place[n]] for _, _, n in pairs]),
        }
    )


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """ROWS for docs(doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    rank = corpus_rarity(texts)
    n = parts or partitions(spark)
    heads = [tuple(h) for h in range_bounds(texts.filter("doc_id is not null").select(F.struct("doc_id", "mark").alias("place")), "place", 3 * n)[0]]

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series, mark: pd.Series) -> pd.Series:
        """The range of a row, and also the one before it if the row starts its own; rows without doc_id go anywhere."""
        out = []
        for null, key, m in zip(doc_id.isna(), doc_id.fillna(0).astype("int64"), mark, strict=True):
            part = bisect_right(heads, (key, m)) - 1
            out.append([-1 - m % (3 * n)] if null else [part, len(heads) + (part - 1) % len(heads)] if heads[part] == (key, m) else [part])
        return pd.Series(out)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: tuple | None = None  # range, doc_id, text: waits for the row after it
        held: list[tuple] = []
        size = 0
        for pdf in batches:
            for part, ghost, doc, text in zip(pdf["part"], pdf["ghost"], pdf["doc_id"], pdf["text"], strict=True):
                if before is not None:
                    follows = part == before[0] and before[1] is not None
                    held.append((before[1], before[2], text if follows else ""))
                    size += len(before[2])
                    before = None
                if not ghost:
                    before = (part, None if pd.isna(doc) else int(doc), text)
                if size > CHUNK:
                    yield _judge(held, rank)
                    held, size = [], 0
        if before is not None:
            held.append((before[1], before[2], ""))
        if held:
            yield _judge(held, rank)

    dealt = texts.withColumn("place", F.explode(places("doc_id", "mark")))
    ghost = F.col("place") >= len(heads) if heads else F.lit(False)
    dealt = dealt.select(F.when(ghost, F.col("place") - len(heads)).otherwise(F.col("place")).alias("part"), ghost.alias("ghost"), "doc_id", "mark", "text")
    # The first row of a range is read once more behind the range before it; of rows that repeat it, one is enough.
    # By number: hashed, several ranges would meet in one task and other tasks stay empty.
    ordered = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "ghost", "doc_id", "mark", "text")
    return ordered.mapInPandas(walk, ROWS)

"""Operator 9, packing by patterns of lengths, fitted with non-negative least squares.

Documents are tokenised where they lie; pieces over the sequence length are cut. Only the histogram of piece
lengths (at most `size` rows) comes to the driver. There all patterns of up to three length bins that fill a
sequence are enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded,
and what is left is packed by best fit, longest first, into the slack of the patterns and new sequences. The
result says, for each length, which ranks of its pieces go to which sequences and offset; a piece's rank is a
count within its partition plus the counts of the partitions before, so no length is gathered in one task.

Defined results: a null text counts as empty, so it is the end id alone; repeated rows are packed as often as
they occur; pieces of one length tie, and take their places in any order. A very long text is tokenised as a whole, in one
task, and cut into pieces. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import Scratch
from traceloom.llm.word_tokens import encoder, slices, tokenizer_path

SIZE, BINS, PARTS = 4096, 128, 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def patterns(bins: int = BINS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All ascending tuples of up to so many bins whose middles add up to a sequence, within half a bin."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], least: int, left: int, more: int) -> None:
        if not more:
            if least <= left <= bins:
                out.append((*head, left))
            return
        for b in range(least, left // (more + 1) + 1):
            extend((*head, b), b, left - b, more - 1)

    for m in range(1, parts + 1):
        extend((), 1, bins + m // 2, m - 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 of least |a x - b|, by active sets on the normal equations.

    Each round lessens the distance, so it ends; should rounding keep it from that, after three rounds an unknown.
    """
    n = a.shape[1]
    gram, goal = a.T @ a, a.T @ b
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(goal).max(initial=0)))
    for _ in range(3 * n):
        w = np.where(passive, -np.inf, goal - gram @ x)
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        passive[j] = True
        while passive.any():
            at = np.flatnonzero(passive)
            z = np.zeros(n)
            z[at] = np.linalg.solve(gram[np.ix_(at, at)] + 1e-9 * np.eye(len(at)), goal[at])
            bad = passive & (z <= 1e-9)
            if not bad.any():
                x = z
                break
            x = x + np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300)) * (z - x)
            passive &= x > 1e-9
            x[~passive] = 0
    return x


def plan(histogram: dict[int, int], size: int = SIZE, bins: int = BINS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces in order, how many such sequences): every piece of the histogram once."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    width = size // bins
    shut: list[tuple[tuple[int, ...], int]] = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    slack: dict[int, list[list]] = defaultdict(list)  # by what is free: [lengths, count]
    kinds = patterns(bins)
    binned = np.array([left[b * width + 1 : (b + 1) * width + 1].sum() for b in range(bins)], float)
    a = np.zeros((bins, len(kinds)))
    for j, kind in enumerate(kinds):
        for b in kind:
            a[b - 1, j] += 1
    repeats = nnls(a, binned) if binned.any() else np.zeros(len(kinds))
    for j in np.argsort(-repeats, kind="stable"):
        wanted = int(round(repeats[j]))
        while wanted > 0:
            lengths: list[int] = []
            for b in sorted(kinds[j], reverse=True):
                if len(lengths) + 1 < len(kinds[j]):  # the longest left in the bin
                    low, high = (b - 1) * width + 1, b * width
                else:  # the longest left that still fits, if it is about as long as the pattern wants
                    high = size - sum(lengths)
                    low = max(1, high - 2 * width)
                took = [x for x in np.flatnonzero(left[low : high + 1])[::-1][: PARTS] + low if left[x] > lengths.count(x)]
                if not took:
                    break
                lengths.append(int(took[0]))
            if len(lengths) < len(kinds[j]):
                break
            n = min(wanted, *(int(left[x]) // lengths.count(x) for x in lengths))
            for x in lengths:
                left[x] -= n
            slack[size - sum(lengths)].append([tuple(lengths), n])
            wanted -= n
    room = np.zeros(size + 1, np.int64)
    for free, groups in slack.items():
        room[free] = len(groups)
    for length in range(size, 0, -1):
        while left[length]:
            fits = np.flatnonzero(room[length:])
            if not len(fits):
                each = size // length
                for copies, n in ((each, int(left[length]) // each), (int(left[length]) % each, 1)):
                    if copies and n:
                        free = size - copies * length
                        slack[free].append([(length,) * copies, n])
                        room[free] += 1
                left[length] = 0
                break
            free = int(fits[0]) + length
            group = slack[free][-1]
            n = min(group[1], int(left[length]))
            left[length] -= n
            group[1] -= n
            if not group[1]:
                slack[free].pop()
                room[free] -= 1
            slack[free - length].append([(*group[0], length), n])
            room[free - length] += 1
    for free in sorted(slack):
        shut += [(tuple(g[0]), g[1]) for g in slack[free]]
    return shut


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank, first sequence and offset of each run of places; its size depends on the sequence length alone."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, n in planned:
        offset = 0
        for length in lengths:
            runs[length].append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for length, r in runs.items()}


def _cutter(path: str, size: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, words, seen = TaskContext.get().partitionId(), encoder(path), np.zeros(size + 1, np.int64)
        for pdf in batches:
            docs, texts = pdf["doc_id"].astype("Int64"), pdf["text"].tolist()
            for a, b in slices(texts):
                ids, at = words.encode(texts[a:b])
                counts = -(-np.diff(at) // size)
                doc = np.repeat(np.arange(a, b), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                first = np.repeat(at[:-1], counts) + piece * size
                length = np.minimum(size, np.repeat(at[1:], counts) - first)
                order = np.argsort(length, kind="stable")  # the how many-th of its length each piece is here
                runs, start, n = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(start, n) + np.repeat(seen[runs], n)
                seen[runs] += n
                raw = ids.astype("<u4")
                sums = [zlib.crc32(raw[x : x + y]) for x, y in zip(first, length, strict=True)]
                yield pd.DataFrame({"doc_id": docs.iloc[doc].array, "piece": piece.astype(np.int32), "start": piece * size, "length": length, "ids_crc32": sums, "part": np.int32(part), "nth": nth})

    return pieces


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "pack")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cut = scratch.save(texts.mapInPandas(_cutter(path or tokenizer_path(), size), PIECES), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(plan(histogram, size, min(BINS, size)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(before, F.lit(0)).alias("_base"))
    ranked = cut.join(bases, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("_base")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                firsts, sequences, offsets = places[int(x)]
                run = np.searchsorted(firsts, rank[at], "right") - 1
                sequence[at], offset[at] = sequences[run] + rank[at] - firsts[run], offsets[run]
            yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

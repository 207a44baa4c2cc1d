"""Operator 10, removing repeated passages with suffix arrays.

Each SPAN-byte window of a text has an anchor (see winnow); equal windows have equal anchors, so the corpus is
dealt in shards by anchor. Segments of one content are one row; an anchor with one segment needs no sorting: its
windows are repeated if the segment occurs twice. The different segments of an anchor, narrowed to what they can
share with another around the anchor, are laid side by side in
blocks of whole anchors of about BLOCK bytes; each block is sorted by induced sorting, and its permuted common
prefixes say which windows also start elsewhere. An anchor of over CROWD different segments, which would not fit
a block, is settled by its windows, counted like words: by 128-bit digests, and where these repeat by the bytes
themselves. Where segments repeat is then joined back to the documents, whose covered bytes go.

Defined results: null texts count as empty; texts under SPAN bytes lose nothing and are no partner; rows that
repeat a text are repeats of each other. Runs of removed bytes that touch are one. Cutting bytes may split a
character; the digest is of the bytes left. A very long text is cut in stretches of 1 MB that overlap by a window, and
equal segments in a row, as periodic text has, are one row. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import Scratch, partitions
from traceloom.llm.components import keyed_join
from traceloom.llm.suffix_arrays import common_prefixes, suffix_array
from traceloom.llm.winnow import SPAN, gram_hashes, segments
from traceloom.llm.word_tokens import slices

BLOCK, CROWD = 1 << 20, 8192
SEPARATOR = b"\xff"  # in no UTF-8 text


def repeated_windows(pieces: list[bytes]) -> list[np.ndarray]:
    """For each of different byte strings, which of its windows also start at another place of any of them."""
    text = np.frombuffer(SEPARATOR.join(pieces) + SEPARATOR, np.uint8)
    before, shared = common_prefixes(text, suffix_array(text))
    found = np.zeros(len(text), bool)
    long = np.flatnonzero(shared >= SPAN)
    found[long] = True
    found[before[long]] = True
    out, at = [], 0
    for p in pieces:
        out.append(found[at : at + max(0, len(p) - SPAN + 1)])
        at += len(p) + 1
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        docs, marks, texts = pdf["doc_id"].astype("Int64"), pdf["mark"].to_numpy(), pdf["text"].tolist()
        for a, b in slices(texts, 1_000_000):
            who, first, runs, repeats, anchor, digest = segments([t.encode() for t in texts[a:b]])
            yield pd.DataFrame({"doc_id": docs.iloc[a + who].array, "mark": marks[a + who], "first": first.astype(np.int32), "windows": runs.astype(np.int32), "repeats": repeats.astype(np.int32), "anchor": anchor.view(np.int64), "digest": digest})


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "mark": pdf["mark"], "packed": [squeeze.compress(t.encode()) for t in pdf["text"]]})


def _slice(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    expand = zstandard.ZstdDecompressor()
    for pdf in batches:
        rows: list[tuple] = []
        for packed, wanted in zip(pdf["packed"], pdf["wanted"], strict=True):
            text = expand.decompress(packed)
            rows += [(w["anchor"], w["digest"], w["n"], w["windows"], text[w["first"] : w["first"] + w["windows"] + SPAN - 1]) for w in wanted]
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=["anchor", "digest", "n", "windows", "bytes"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["anchor", "digest", "n", "windows", "bytes"])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def narrowed(anchors: list[int], pieces: list[bytes]) -> list[tuple[int, int]]:
    """The range of each piece in which windows can be repeated, empty if there is none; pieces of an anchor stand together.

    Equal windows have their anchor at the same place, so what two pieces share around their anchors, to the left
    and to the right, bounds them; the most that a piece shares is with a neighbour in sorted order.
    """
    lens = np.array([len(p) for p in pieces])
    starts = np.cumsum(lens) - lens
    hashes = gram_hashes(np.frombuffer(b"".join(pieces), np.uint8)).view(np.int64)
    hits = np.flatnonzero(hashes == np.repeat(np.array(anchors, np.int64), lens)[: len(hashes)])
    middle = (hits[np.searchsorted(hits, starts)] - starts).tolist()
    ahead = [p[m:] for p, m in zip(pieces, middle, strict=True)]
    behind = [p[m - 1 :: -1] if m else b"" for p, m in zip(pieces, middle, strict=True)]
    reach = []
    for sides in (behind, ahead):
        most = [0] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: (anchors[i], sides[i]))
        for i, j in pairwise(order):
            if anchors[i] == anchors[j]:
                k = _common(sides[i], sides[j])
                most[i], most[j] = max(most[i], k), max(most[j], k)
        reach.append(most)
    return [(m - a, m + b) if a + b >= SPAN else (0, 0) for m, a, b in zip(middle, *reach, strict=True)]


def _sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []
    size, last = 0, None

    def settle() -> pd.DataFrame:
        ranges = narrowed([h[0] for h in held], [h[3] for h in held])
        kept = [(h[1], h[2], low, h[3][low:high]) for h, (low, high) in zip(held, ranges, strict=True) if high]
        rows = []
        for (digest, n, start, _), flags in zip(kept, repeated_windows([k[3] for k in kept]), strict=True):
            if n == 1:  # the others are repeated as wholes
                rows += [(digest, start + low, start + high) for low, high in _runs(flags)]
        return pd.DataFrame(rows, columns=["digest", "low", "high"]).astype({"low": np.int32, "high": np.int32})

    for pdf in batches:
        for anchor, digest, n, data in zip(pdf["anchor"], pdf["digest"], pdf["n"], pdf["bytes"], strict=True):
            if size >= BLOCK and anchor != last:
                yield settle()
                held, size = [], 0
            held.append((anchor, digest, n, data))
            size, last = size + len(data), anchor
    if held:
        yield settle()


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for digest, n, count, data in zip(pdf["digest"], pdf["n"], pdf["windows"], pdf["bytes"], strict=True):
            yield pd.DataFrame({"digest": digest, "n": n, "low": np.arange(count, dtype=np.int32), "window": [xxhash.xxh3_128_digest(data[k : k + SPAN]) for k in range(count)]})


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    expand = zstandard.ZstdDecompressor()
    for pdf in batches:
        rows = []
        for doc, packed, spans in zip(pdf["doc_id"].astype("Int64"), pdf["packed"], pdf["spans"], strict=True):
            text = expand.decompress(packed)
            kept, at, gone, n = [], 0, 0, 0
            end = -1
            for low, high in sorted((s["low"], s["high"]) for s in spans) if spans is not None else ():
                if low > end:
                    kept.append(text[at:low])
                    n += 1
                gone += max(0, high - max(low, end))
                end = at = max(end, high)
            kept.append(text[at:])
            rows.append((doc, len(text), gone, n, b"".join(kept)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "repeats"), partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    cut = texts.filter(F.octet_length("text") >= SPAN).mapInPandas(_cut, "doc_id long, mark long, first int, windows int, repeats int, anchor long, digest binary")
    cut = scratch.save(cut, "cut")
    again = cut.groupBy("anchor").agg(F.sum("repeats").alias("m")).filter("m > 1").drop("m")
    places = scratch.save(keyed_join(cut, again, "anchor"), "places")
    scratch.drop("cut")
    kinds = places.groupBy("anchor", "digest").agg(F.sum("repeats").alias("n"), F.min(F.struct("doc_id", "mark", "first", "windows")).alias("at"))
    kinds = scratch.save(kinds, "kinds")
    whole = kinds.filter("n > 1").select("digest", F.lit(0).alias("low"), F.col("at.windows").alias("high"))

    # The bytes of one segment of each kind, where an anchor has several kinds and one of them occurs once.
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").drop("least")
    wanted = keyed_join(kinds, mixed, "anchor").withColumn("id", F.coalesce("at.doc_id", F.lit(-1)))
    wanted = wanted.groupBy("id", "at.mark").agg(F.collect_list(F.struct("anchor", "digest", "n", "at.first", "at.windows")).alias("wanted"))
    packed = texts.mapInPandas(_pack, "doc_id long, mark long, packed binary").withColumn("id", F.coalesce("doc_id", F.lit(-1)))
    once = packed.select("id", "mark", "packed").join(wanted, ["id", "mark"]).select("wanted", "packed")
    pieces = once.mapInPandas(_slice, "anchor long, digest binary, n long, windows int, bytes binary").dropDuplicates(["digest"])
    pieces = scratch.save(pieces, "pieces")
    pieces = keyed_join(pieces, mixed, "anchor")
    sorted_ = pieces.filter(F.col("kinds") <= CROWD).select("anchor", "digest", "n", "bytes").repartition(n, "anchor").sortWithinPartitions("anchor")
    runs = sorted_.mapInPandas(_sort, "digest binary, low int, high int")
    counted = pieces.filter(F.col("kinds") > CROWD).select("digest", "n", "windows", "bytes").mapInPandas(_windows, "digest binary, n long, low int, window binary")
    common = counted.groupBy("window").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    # Digests only choose; what they choose is compared byte by byte.
    repeated = keyed_join(keyed_join(counted, common, "window"), pieces.select("digest", "bytes"), "digest").select("digest", "n", "low", F.substring("bytes", F.col("low") + 1, F.lit(SPAN)).alias("bytes"))
    equal = repeated.groupBy("bytes").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    single = keyed_join(repeated.filter("n = 1"), equal, "bytes").select("digest", "low", (F.col("low") + 1).alias("high"))
    found = scratch.save(whole.unionByName(runs).unionByName(single), "found")
    scratch.drop("kinds")
    scratch.drop("pieces")

    ranges = keyed_join(places.select("doc_id", "mark", "first", "digest", ((F.col("repeats") - 1) * F.col("windows")).alias("more")), found, "digest")
    # A segment in a row with equal ones is found as a whole, and so are they.
    ranges = ranges.select(F.coalesce("doc_id", F.lit(-1)).alias("id"), "mark", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("more") + F.col("high") - 1 + SPAN).alias("high"))
    # As long as a document's text at most.
    spans = ranges.groupBy("id", "mark").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    return packed.join(spans, ["id", "mark"], "left").select("doc_id", "packed", "spans").mapInPandas(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest_rows(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

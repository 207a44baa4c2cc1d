"""Operator 5, binary token output: concatenated ids with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id, encoded, and written in that order as blocks of about
BLOCK_TOKENS ids; each block is one self-contained binary record:

    magic `TLTOKEN2`, bytes an id (2 or 4), number of documents, of those without doc_id (they come first), first
    doc_id, Elias-Fano code of the doc_ids over the first (ascending), Elias-Fano code of the boundaries
    (documents + 1 values), ids (little-endian)

Blocks are kept in a Parquet table, so any file system that Spark writes to will do, and a lost executor's
half-written blocks are never seen. A select on the boundaries finds a document without reading the ids
before it; where a partition's ids start in the whole array follows from the partitions' totals, one row each.

Defined results: a null text counts as empty and gives the end id alone; null doc_ids come first; rows of
equal doc_id are ordered by a hash of their text, by which many of them are also dealt to several tasks. A very long text is
one document, encoded in one task and one block. An empty table gives no block and no row. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import Scratch, partitions
from traceloom.llm.elias_fano import EliasFano
from traceloom.llm.word_tokens import encoder, slices, tokenizer_path

MAGIC = b"TLTOKEN2"
BLOCK_TOKENS = 1 << 17
_HEAD = struct.Struct("<8sBIIq")
BLOCKS = "part int, block int, first_doc long, n_docs int, n_tokens long, part_start long, payload binary"


def pack_block(doc_ids: list, ids: np.ndarray, bounds: np.ndarray, id_bytes: int) -> bytes:
    """doc_ids ascending, None first."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    over = np.array([d - first for d in known], np.uint64)
    return _HEAD.pack(MAGIC, id_bytes, len(doc_ids), len(doc_ids) - len(known), first) + EliasFano.encode(over).to_bytes() + EliasFano.encode(bounds).to_bytes() + ids.astype(f"<u{id_bytes}").tobytes()


def open_block(payload: bytes) -> tuple[list, EliasFano, np.ndarray]:
    """(doc_ids, boundaries, ids as a view of the payload)."""
    magic, id_bytes, n, nulls, first = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    over, at = EliasFano.from_bytes(payload, _HEAD.size)
    bounds, at = EliasFano.from_bytes(payload, at)
    return [None] * nulls + [first + k for k in over.select_many(np.arange(n - nulls)).tolist()], bounds, np.frombuffer(payload, f"<u{id_bytes}", -1, at)


def document_ids(payload: bytes, i: int) -> np.ndarray:
    """The ids of the block's i-th document, found by select."""
    _, bounds, ids = open_block(payload)
    return ids[bounds.select(i) : bounds.select(i + 1)]


def _writer(path: str):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, start, words = TaskContext.get().partitionId(), 0, 0, encoder(path)
        keys: list = []
        parts: list[np.ndarray] = []
        bounds, held = [0], 0

        def flush() -> pd.DataFrame:
            nonlocal block, start, held, keys, parts, bounds
            ids = np.concatenate(parts)
            row = (part, block, keys[0], len(keys), held, start, pack_block(keys, ids, np.array(bounds), words.id_bytes))
            block, start, held, keys, parts, bounds = block + 1, start + held, 0, [], [], [0]
            return pd.DataFrame([row], columns=["part", "block", "first_doc", "n_docs", "n_tokens", "part_start", "payload"]).astype({"first_doc": "Int64"})

        for pdf in batches:
            docs = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
            texts = pdf["text"].tolist()
            for a, b in slices(texts):
                ids, at = words.encode(texts[a:b])
                for k in range(b - a):
                    keys.append(docs[a + k])
                    parts.append(ids[at[k] : at[k + 1]])
                    held += int(at[k + 1] - at[k])
                    bounds.append(held)
                    if held >= BLOCK_TOKENS:
                        yield flush()
        if keys:
            yield flush()

    return blocks


def write_blocks(docs: DataFrame, scratch: Scratch, path: str | None = None, label: str = "tokens", parts: int | None = None) -> DataFrame:
    """The table of blocks for docs(doc_id, text), in ascending doc_id order within and between its partitions."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    order = (F.col("doc_id").asc_nulls_first(), "mark")
    ordered = texts.repartitionByRange(parts or partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return scratch.save(ordered.mapInPandas(_writer(path or tokenizer_path()), BLOCKS), label, "zstd")


def partition_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each partition: one row for each partition of the write, ordered by its first document."""
    first = F.min_by("first_doc", "block")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"), first.alias("first")).collect()
    starts, at = {}, 0
    for r in sorted(totals, key=lambda r: (r["first"] is not None, r["first"] or 0, r["part"])):
        starts[r["part"]], at = at, at + r["n"]
    return starts


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks alone."""
    starts = partition_starts(blocks.select("part", "block", "first_doc", "n_tokens"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, part_start, payload in zip(pdf["part"], pdf["part_start"], pdf["payload"], strict=True):
                keys, code, ids = open_block(payload)
                bounds, wide = code.select_many(np.arange(code.n)), ids.astype("<u4")
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "start": bounds[:-1] + part_start + starts[part], "n_tokens": np.diff(bounds), "ids_crc32": sums})

    return blocks.select("part", "part_start", "payload").mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")

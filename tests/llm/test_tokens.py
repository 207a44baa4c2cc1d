import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceloom.llm import packing, token_files
from traceloom.llm.common import Scratch
from traceloom.llm.elias_fano import EliasFano
from traceloom.llm.word_tokens import encoder, tokenizer_path

TEXTS = [
    (3, "The cat  sat\ton the mat."), (1, None), (2, ""), (9, "word " * 9000), (7, "a\x1cb <|endoftext|> c\x0bd"), (7, "ΣΑΣ don't é"), (None, "no id"),
]
SCHEMA = "doc_id long, text string, payload string, part string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", None) for i, t in TEXTS], SCHEMA).repartition(3)


def expected_ids(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def test_word_cache_equals_whole_text_encoding():
    words = encoder(tokenizer_path())
    texts = [t or "" for _, t in TEXTS]
    ids, at = words.encode(texts)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == expected_ids(text)


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 900], list(range(0, 40000, 7)), [0, 1 << 33], [3] * 500 + [1 << 20] * 300, [0, (1 << 63) - 1], list(np.cumsum(np.random.default_rng(0).integers(0, 5000, 900)))])
def test_elias_fano_round_trip(values):
    code, end = EliasFano.from_bytes(b"xx" + EliasFano.encode(np.array(values)).to_bytes(), 2)
    assert code.all().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values
    assert code.select_many(np.arange(len(values))[::-1]).tolist() == values[::-1]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_token_files_round_trip(spark, docs):
    blocks = token_files.write_blocks(docs, Scratch(spark, "t"), parts=3)
    got = sorted(map(tuple, token_files.read_documents(blocks).collect()), key=lambda r: r[1])
    marks = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1] or ""]))
    start, want = 0, []
    for doc, text in order:
        ids = expected_ids(text)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    payload = blocks.filter("part = 0").orderBy("block").first()["payload"]
    assert token_files.document_ids(bytes(payload), 0).tolist() == expected_ids(order[0][1])


def test_token_files_of_an_empty_table(spark, docs):
    assert token_files.read_documents(token_files.write_blocks(docs.limit(0), Scratch(spark, "t"))).count() == 0


def test_packing_places_every_piece_once(spark, docs):
    rows = packing.pack(docs.unionByName(docs)).collect()
    want = []
    for doc, text in TEXTS * 2:
        ids = expected_ids(text)
        want += [(doc, k, k * 4096, len(ids[k * 4096 : (k + 1) * 4096]), crc(ids[k * 4096 : (k + 1) * 4096])) for k in range(-(-len(ids) // 4096))]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [np.full(1000, 1500), np.arange(1, 4097), np.random.default_rng(3).integers(1, 4096, 5000), np.array([4096, 4096, 1])])
def test_plan_is_near_the_bound(lengths):
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True))
    planned = packing.plan(histogram)
    placed = {}
    for pieces, n in planned:
        assert sum(pieces) <= 4096
        for x in pieces:
            placed[x] = placed.get(x, 0) + n
    assert placed == histogram
    alone = (lengths > 2048).sum() if (lengths != 1500).any() else 500
    assert sum(n for _, n in planned) <= 1.02 * max(alone, lengths.sum() / 4096) + 1

"""Operators 7 and 10 and their parts against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import near_dup, suffix_dedup
from traceloom.llm.components import connected
from traceloom.llm.common import Scratch
from traceloom.llm.shingles import band_hashes, shingle_sets, similar, sketches
from traceloom.llm.suffix_arrays import common_prefixes, suffix_array
from traceloom.llm.winnow import SPAN, segments

VOCAB = ["w%d" % i for i in range(500)]


def corpus(seed=1):
    r = random.Random(seed)
    base = [[r.choice(VOCAB) for _ in range(r.choice([3, 8, 40, 200]))] for _ in range(40)]
    docs = []
    for k, words in enumerate(base):
        docs.append(words)
        for _ in range(k % 5):
            new = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                new[r.randrange(len(new))] = r.choice(VOCAB)
            docs.append(new)
    shared = [r.choice(VOCAB) for _ in range(120)]
    docs += [[r.choice(VOCAB) for _ in range(30)] + shared + [r.choice(VOCAB) for _ in range(30)] for _ in range(12)]
    texts = [" ".join(d) for d in docs]
    r.shuffle(texts)
    return texts


def odd_rows(texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "One"), (904, "ONE"), (905, "one two"), (906, "one  two\n"), (907, "É a b"), (908, "é a b"), (909, rows[3][1].upper()), (910, "x " * 4000), (910, "other words are here now")]
    return rows + [(None, rows[0][1]), (None, "nobody has these words at all")]


def word_sets(text, size):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_groups(rows, size, percent):
    sets = [word_sets(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, size, percent, monkeypatch):
    monkeypatch.setattr(near_dup, "ASKING", 3)
    monkeypatch.setattr(near_dup, "ASKED", 5)
    monkeypatch.setattr(near_dup, "SALT", 4)
    rows = odd_rows(corpus())
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, kept int, node string").repartition(3)
    got = sorted(map(tuple, near_dup.near_groups(docs, size, percent).collect()), key=str)
    assert got == brute_groups(rows, size, percent)


def test_one_of_each_keeps_columns(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g", 1), (3, "a b c d e f g", 2), (9, None, 3), (10, "something else is here", 4)], "doc_id long, text string, component_id int")
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 9, 10]
    assert near_dup.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("names", [("_jk", "_lh"), ("id", "mark"), ("rows", "first"), ("extra", "doc"), ("node", "ID_")])
def test_one_of_each_tells_rows_apart_by_their_texts(spark, names):
    t, u = "a b c d e f g h", "nothing like the other text at all here"
    rows = [(3, t, 0, 1), (5, t, 0, 2), (5, u, 0, 3), (None, t, 0, 4), (None, u + " x y z", 0, 5), (7, "w " * 9, 0, 6), (7, "w " * 9, 1, 6), (None, None, 0, 7), (8, "", 0, 8)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {names[0]} int, {names[1]} int")
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r[3] for r in kept.collect()) == [1, 3, 5, 6, 7, 8]


def test_a_crowded_bucket_of_unlike_texts_moves_in_proportion(spark, monkeypatch):
    """3,000 unlike sets in one bucket, two of them similar but neither the centre of a star."""
    r = np.random.default_rng(5)
    fixed = np.array([(k << 54) + 7 for k in range(10)], np.uint64)  # the same low hashes in the first bins
    sets = [np.unique(np.append(fixed, r.integers(0, 1 << 63, 30, dtype=np.uint64))) for _ in range(3000)]
    twin = np.unique(np.append(sets[100][:-1], r.integers(0, 1 << 63, 1, dtype=np.uint64)))
    rows_each, sets = near_dup.rows_per_band(80), [*sets, twin]
    bands, again = band_hashes(sketches(sets, near_dup.BANDS * rows_each), near_dup.BANDS), band_hashes(sketches(sets, near_dup.BANDS * rows_each, 1), near_dup.BANDS)
    bands[:, 0] = 1  # one bucket holds all
    monkeypatch.setattr(near_dup, "ASKED", 500)
    monkeypatch.setattr(near_dup, "ASKING", 100)
    table = spark.createDataFrame([(near_dup._set_key(s), s.tobytes(), b.tolist(), g.tolist()) for s, b, g in zip(sets, bands, again, strict=True)], "node binary, set binary, bands array<long>, again array<long>")
    placed = table.select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("band"), "node", F.col("node").alias("comp"))
    blocks = near_dup._open_blocks(placed, table)
    assert blocks.count() < 3 * near_dup.BANDS * len(sets)
    blocks = blocks.repartition(4, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    links = {frozenset(map(bytes, x)) for x in blocks.mapInPandas(near_dup._block_tester(80), "a binary, b binary").collect()}
    assert links == {frozenset((near_dup._set_key(sets[100]), near_dup._set_key(twin)))}


def test_sketches_agree_as_often_as_sets_do():
    r = np.random.default_rng(0)
    for n, common in ((7, 6), (40, 30), (2000, 1700)):
        agree = []
        for _ in range(60):
            s = r.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            a, b = np.sort(s[:n]), np.sort(s[n - common :])
            x, y = sketches([a, b], 120)
            agree.append((x == y).mean())
        assert np.mean(agree) == pytest.approx(common / (2 * n - common), abs=0.04)


def test_pairs_at_the_limit_share_a_band():
    r = np.random.default_rng(1)
    for percent in (80, 85):
        rows, missed = near_dup.rows_per_band(percent), 0
        for n in [20, 40, 100, 400] * 50:
            common = -(-2 * n * percent // (100 + percent))
            s = r.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            a, b = np.unique(s[:n]), np.unique(s[n - common :])
            assert similar(a, b, percent)
            x, y = band_hashes(sketches([a, b], rows * near_dup.BANDS), near_dup.BANDS)
            missed += not (x == y).any()
        assert missed == 0


def test_shingles_count_like_words():
    texts = [t or "" for _, t in odd_rows(corpus(2))]
    for size in (1, 3, 5):
        assert [len(s) for s in shingle_sets(texts, size)] == [len(word_sets(t, size)) for t in texts]
    a, b = shingle_sets(["A B c d", "a b C d"], 3)
    assert a.tolist() == b.tolist()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("s0", f"s{i}") for i in range(1, 40)] + [("c010", "c010")]
    links = spark.createDataFrame(edges, "a string, b string")
    got = {r["node"]: r["comp"] for r in connected(links, Scratch(spark, "cc"), "t").collect()}
    assert set(got.values()) == {"c000", "s0"} and len(got) == 101
    assert connected(links.limit(0), Scratch(spark, "cc"), "t").count() == 0


def test_suffix_arrays_and_prefixes():
    r = np.random.default_rng(0)
    for trial in range(120):
        t = r.integers(0, r.integers(1, 5), r.integers(1, 60)).astype(np.uint8)
        t = np.tile(t, 1 + trial % 4)
        data = t.tobytes()
        want = sorted(range(len(data) + 1), key=lambda i: data[i:])
        assert suffix_array(t).tolist() == want
        before, shared = common_prefixes(t, suffix_array(t))
        for x, y in zip(want[1:], want[2:], strict=False):
            k = 0
            while max(x, y) + k < len(data) and data[x + k] == data[y + k]:
                k += 1
            assert before[y] == x and shared[y] == k


@pytest.mark.parametrize("most", [1 << 20, 170, 61])
def test_segments_cover_each_window_once_and_follow_content(most):
    r = random.Random(4)
    passage = r.randbytes(300)
    texts = [r.randbytes(700), r.randbytes(150) + passage + r.randbytes(99), passage, b"a" * 450, b"", r.randbytes(199), r.randbytes(200)]
    who, first, runs, repeats, anchor, digest = segments(texts, most)
    windows = {}
    for w, f, n, k, a in zip(who, first, runs, repeats, anchor, strict=True):
        for s in range(f, f + n * k):
            assert (w, s) not in windows
            windows[w, s] = a
    assert len(windows) == sum(max(0, len(t) - SPAN + 1) for t in texts)
    by = {}
    for (w, s), a in windows.items():
        assert by.setdefault(texts[w][s : s + SPAN], a) == a
    if most > 1000:
        assert repeats.max() > 1 and (repeats * runs).sum() == len(windows)
    assert len({windows[3, s] for s in range(251)}) == 1


def test_periodic_text_is_few_segments():
    for text in (b"a" * 2_000_000, b"abc" * 400_000, b"all work and no play " * 50_000):
        who, first, runs, repeats, anchor, digest = segments([text])
        assert len(who) < 10 and (runs * repeats).sum() == len(text) - SPAN + 1


def brute_removal(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + SPAN] for _, b in texts for i in range(len(b) - SPAN + 1))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - SPAN + 1):
            if seen[b[i : i + SPAN]] > 1:
                gone[i : i + SPAN] = [True] * SPAN
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [8192, 2])
def test_removal_equals_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdé ßf\n\0") for _ in range(n))
    passages = [text(n) for n in (150, 199, 200, 201, 420)]
    rows = [(i, text(r.randrange(120)) + r.choice(passages) + text(r.randrange(120)) + (r.choice(passages) if i % 3 else "")) for i in range(60)]
    rows += [(100, "ab" * 400), (101, "x" * 1000), (102, "x" * 199), (103, None), (104, ""), (105, passages[4]), (105, passages[4]), (107, "abcdefg" * 99 + "x" + "abcdefg" * 60), (108, "é" * 150), (109, "z" * 200 + "y" * 200), (None, passages[3]), (None, text(700)), (106, text(300) * 2)]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, mark string").repartition(4)
    got = sorted(map(tuple, suffix_dedup.digest_rows(suffix_dedup.remove_repeats(docs)).collect()), key=str)
    assert got == brute_removal(rows)


def test_removal_of_nothing(spark):
    docs = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert rows == {1: b"short", 2: b""} and suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_narrowing_loses_no_repeated_window():
    r = random.Random(3)
    core = bytes(r.choice(b"abcdefgh") for _ in range(260))
    pieces = [bytes(r.choice(b"abc") for _ in range(r.randrange(60))) + core[r.randrange(30) :] for _ in range(8)]
    pieces = [p + bytes(r.choice(b"abc") for _ in range(60)) for p in pieces]
    who, first, runs, _, anchor, _ = segments(pieces)
    groups = {}
    for w, f, n, a in zip(who, first, runs, anchor, strict=True):
        groups.setdefault(int(np.uint64(a).view(np.int64)), {})[pieces[w][f : f + n + SPAN - 1]] = None
    held = [(a, p) for a, ps in groups.items() for p in ps]
    ranges = suffix_dedup.narrowed([a for a, _ in held], [p for _, p in held])
    whole = suffix_dedup.repeated_windows([p for _, p in held])
    for (low, high), flags in zip(ranges, whole, strict=True):
        for i in np.flatnonzero(flags):
            assert low <= i and i + SPAN <= high

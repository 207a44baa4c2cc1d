"""Operators 2, 3 and 8 against brute force and held-out accuracy."""

import hashlib
import random
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.llm import feature_digest, language, page_diff

WORDS = {"en": "the and of with from this that have which there their would", "de": "der die und nicht eine werden auch für über schön haben sich", "fr": "le la les des une est dans pour que avec être même", "es": "el los las una que para como está señor también muy pero"}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def test_language_on_held_out_texts(spark):
    rows = [(i, prose(lang, 5 + i % 40, i), lang) for i in range(400) for lang in [sorted(WORDS)[i % 4]]]
    odd = [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (None, "the and of which", "en"), (1003, "der die und " * 20000, None)]
    docs = spark.createDataFrame([(*r, "lang_pred") for r in rows + odd], "doc_id long, text string, lang string, score string").repartition(4)
    out = language.identify(docs)
    assert out.count() == len(rows) + len(odd)
    got = {r["doc_id"]: r for r in out.collect()}
    import zlib

    for i, _, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(i, lang) for i, _, lang in rows if got[i]["held_out"]]
    assert len(held) > 50 and np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    assert got[1003]["lang_pred"] == "de" and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1000, 1001, 1002)").count() == 0 and kept.count() >= 400
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0
    assert language.accepted(docs.withColumn("lang", F.lit(None).cast("string"))).count() == len(rows) + 2  # nothing to reject by


def test_long_texts_are_counted_whole(monkeypatch):
    text = prose("de", 3000, 1)
    whole = language.gram_counts(text)
    raw = f" {text} ".encode()
    assert whole.sum() == len(raw) - 2
    monkeypatch.setattr(language, "PIECE", 37)
    assert (language.gram_counts(text) == whole).all()


def test_machines_against_an_exact_solution():
    """The dual of two points has one solution; more points meet its conditions."""
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 5))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    kernel = x @ x.T + 1
    dual = language.svm(kernel, y, cost=2.0, epochs=20_000)
    alpha, margin = dual * y, y * (kernel @ dual)
    assert (alpha >= 0).all() and (alpha <= 2).all()
    assert (margin[alpha < 1e-9] > 0.98).all() and (margin[alpha > 2 - 1e-9] < 1.02).all() and np.abs(margin[(alpha > 1e-9) & (alpha < 2 - 1e-9)] - 1).max() < 0.02
    two = language.svm(np.array([[2.0, 1 - 1.0], [1 - 1.0, 2.0]]), np.array([1.0, -1.0]), cost=9.0, epochs=500)
    assert np.allclose(two, [0.5, -0.5])  # minimises a'Ka/2 - sum(a) with K = 2I


def test_rare_languages_are_learned(spark):
    rows = [(i, f"{prose('en', 4, i)} " + f"{chr(0x3B1 + i % 230)}{chr(0x5D0 + i % 23)} " * 8, f"x{i % 230:03d}") for i in range(230 * 6)]
    rows += [(10_000 + i, prose("en", 12, i), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = Counter(r["lang"] for r in language.sample(docs).collect())
    assert language.sample(docs.union(docs)).count() <= sum(learned.values())  # a repeated row is learned from once
    known = {r["lang"]: r["count"] for r in docs.filter(~language.held_out(F.col("doc_id"))).groupBy("lang").count().collect()}
    assert len(known) > 220 and set(learned) == set(known)
    assert all(learned[x] == known[x] for x in known if x != "en") and 0 < learned["en"] < 60


def test_one_versus_one_votes():
    rows = [(lang, np.flatnonzero(n), n[n > 0] / n.sum()) for lang in WORDS for k in range(20) for n in [language.gram_counts(prose(lang, 30, k))]]
    model = language.train(rows)
    assert set(model.families) == {"germanic", "romance"} and sorted(model.pairs) == [("de", "en"), ("es", "fr")]
    assert model.predict([prose(x, 12, 99) for x in WORDS])[0] == list(WORDS)


ARTICLE = "<article><h1>Head</h1><p>One  two\n three &amp; &lt;four&gt;</p><p>Shared line</p></article>"
NAV = "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div><div id=main-sidebar>Side</div>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("plain &eacute;\xa0 text", "plain é text"), (NAV + ARTICLE + "<footer>x</footer>", "Head\nOne two three & <four>\nShared line"),
        ("<script>var t='</p>';</script><style>p{}</style><p>a<b>b</b>c<br>d", "abc\nd"), ("<p>a</p><!-- <p>no</p> --><p>b", "a\nb"),
        ("<nav>unclosed <article><p>in</p></article>", "in"), ("<article><header><h1>T</h1></header><p>x</p><section class='comments'><p>nice</p></section></article>", "T\nx"),
        ("<main><p>x</p><form><input>Mail</form><aside>More</aside></main><p hidden>no</p>", "x"), ("<p>cut <b", "cut"), ("<table><tr><td>a</td><td>b</td></tr></table>", "a\nb"),
        ("<div role='navigation'>n</div><p style='display: none'>h</p><p>ok</p>", "ok"), ("<div class=ad><div>in</div>ad</div>rest", "rest"),
        ("<div class='page-header'>S</div><article><div class='entry-header'><h1>T</h1></div><p>x</p><ol class='commentlist'><li>c</ol><div class='share-buttons'>Share</div></article>", "T\nx"),
    ],
)
def test_lines_by_markup(html, text):
    assert page_diff.main_text(page_diff.lines(html), None) == text


def brute_lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_common_subsequence_is_longest():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        found = page_diff.common_subsequence(a, b)
        assert len(found) == brute_lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in sorted(found))


def test_pages_are_compared_with_the_nearest_url(spark):
    page = lambda body: f"<p>Site name</p><p>{body}</p><p>Imprint</p>"
    rows = [(i, f"http://h{i % 3}.com/a/{i:03d}?x", page(f"own {i}"), 0) for i in range(60)] + [(100, "http://alone.com/", page("own"), 0), (101, None, None, 0), (None, "no", page("own"), 0), (102, None, page("own"), 0)]
    copies = [(200 + i, "http://copy.com/p", f"{ARTICLE}<p>Site name</p>", 0) for i in range(4)]
    pages = spark.createDataFrame(rows + copies, "page_id long, url string, html string, key int").repartition(3)
    for parts in (1, 5):
        got = {r["page_id"]: r for r in page_diff.extract(pages, parts).collect()}
        assert len(got) == len(rows) + len(copies)
        assert all(got[i]["text"] == f"own {i}" and got[i]["n_chars"] == len(f"own {i}") for i in range(60))
        assert got[100]["text"] == got[102]["text"] == got[None]["text"] == "Site name\nown\nImprint" and got[101]["text"] == ""
        assert all(got[200 + i]["text"] == "Head\nOne two three & <four>\nShared line" for i in range(4))
    assert page_diff.extract(pages.limit(0)).count() == 0


class Article(HTMLParser):
    """Another reading of the test pages: blocks of text inside <article>, tag by tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.open = 0, [""], 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.open += bool(self.inside) and tag in ("script", "style")
        if tag in page_diff.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in page_diff.BLOCKS:
            self.blocks.append("")
        self.inside -= tag == "article"
        self.open -= bool(self.inside) and tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.open:
            self.blocks[-1] += data


@pytest.mark.parametrize("parts", [2, 7])
def test_every_test_page_gives_its_article(spark, parts):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in page_diff.extract(pages, parts).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        other = Article()
        other.feed(r["html"] or "")
        want = "\n".join(b for b in (" ".join(b.split()) for b in other.blocks) if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_entropy_levels_equal_those_of_each_window():
    w, buf = feature_digest.WINDOW, np.frombuffer(random.Random(1).randbytes(50) * 3 + b"aaaa" * 30, np.uint8) % 7
    got = feature_digest.entropy_levels(buf)
    for i in range(len(buf) - w + 1):
        n = np.bincount(buf[i : i + w])
        bits = -(n[n > 0] / w * np.log2(n[n > 0] / w)).sum()
        assert abs(got[i] - bits / np.log2(w) * feature_digest.LEVELS) < 1.5


def brute_features(text, rank):
    w = feature_digest.WINDOW
    b = text if len(text) >= w or not text else text.ljust(w, b"\0")
    if not b:
        return []
    levels = feature_digest.entropy_levels(np.frombuffer(b, np.uint8))
    points = [0] * len(levels)
    for i in range(len(levels)):
        points[min(range(i, min(i + w, len(levels))), key=lambda k: (rank[levels[k]], k))] += 1
    need = min(feature_digest.POINTS, max(1, len(levels) // 2))
    return [i for i, p in enumerate(points) if p >= need]


def test_features_equal_brute_force_in_any_grouping():
    texts = [prose(x, n, n).encode() for n in (0, 1, 3, 9, 60, 300) for x in WORDS] + [b"", b"a" * 500]
    rank = feature_digest.rarity(feature_digest.level_counts(texts))
    buf, starts, windows = feature_digest._buffer(texts)
    at, owner = feature_digest._select(buf, starts, windows, rank)
    for k, t in enumerate(texts):
        assert (at[owner == k] - starts[k]).tolist() == brute_features(t, rank)
    assert sum(feature_digest.level_counts([t]).sum() for t in texts) == feature_digest.level_counts(texts).sum()
    alone = [feature_digest.to_text(feature_digest.digests([t], rank)[0]) for t in texts]
    assert alone == [feature_digest.to_text(d) for d in feature_digest.digests(texts, rank)]


def test_long_texts_have_the_same_features_in_pieces(monkeypatch):
    texts = [prose("en", 900, 1).encode(), b"a" * 3000, b"0123456789" * 300, random.Random(3).randbytes(3000), prose("fr", 700, 2).encode() * 2, b"x" * 1501, b"ab" * 800 + random.Random(4).randbytes(50) + b"ab" * 800]
    rank = feature_digest.rarity(feature_digest.level_counts(texts))
    whole = [(feature_digest.level_counts([t]).tolist(), feature_digest.to_text(feature_digest.digests([t], rank)[0])) for t in texts]
    for chunk in (100, 333, 1500):
        monkeypatch.setattr(feature_digest, "CHUNK", chunk)
        assert [(feature_digest.level_counts([t]).tolist(), feature_digest.to_text(feature_digest.digests([t], rank)[0])) for t in texts] == whole


def brute_digest(text, rank):
    """Chained Bloom filters bit by bit, from the features of brute_features()."""
    f, seen, chain = feature_digest, [], []
    b = text if len(text) >= f.WINDOW or not text else text.ljust(f.WINDOW, b"\0")
    for i in brute_features(text, rank):
        h = 0x9E3779B97F4A7C15
        for k in range(0, f.WINDOW, 8):
            h = (h ^ int.from_bytes(b[i + k : i + k + 8], "little")) * 0xFF51AFD7ED558CCD % (1 << 64)
            h ^= h >> 32
        h = h * 0xC4CEB9FE1A85EC53 % (1 << 64)
        h ^= h >> 29
        if h in seen:
            continue
        if len(seen) % f.FILL == 0:
            chain.append([0] * f.BITS)
        seen.append(h)
        for k in range(f.HASHES):
            chain[-1][(h >> 11 * k) % f.BITS] = 1
    return chain, len(seen)


def brute_likeness(x, y):
    f, (a, na), (b, nb) = feature_digest, x, y
    if x == y:
        return 1.0
    if not a or not b:
        return 0.0
    sizes = lambda chain, n: [f.FILL] * (len(chain) - 1) + [n - (len(chain) - 1) * f.FILL]

    def score(p, n, q, m):
        most, both, keep = min(sum(p), sum(q)), sum(i & j for i, j in zip(p, q, strict=True)), 1 - 1 / f.BITS
        chance = f.BITS * (1 - keep ** (f.HASHES * n) - keep ** (f.HASHES * m) + keep ** (f.HASHES * (n + m)))
        floor = min(chance + f.CHANCE_MARGIN * (most - chance), most - 1e-9)
        return min(1.0, max(0.0, (both - floor) / (most - floor)))

    mean = lambda c, n, d, m: sum(k * max(score(p, k, q, j) for q, j in zip(d, sizes(d, m), strict=True)) for p, k in zip(c, sizes(c, n), strict=True)) / n
    ways = [mean(a, na, b, nb)] * (len(a) <= len(b)) + [mean(b, nb, a, na)] * (len(b) <= len(a))
    return sum(ways) / len(ways)


def test_filters_and_likeness_equal_brute_force(monkeypatch):
    monkeypatch.setattr(feature_digest, "FILL", 40)  # longer chains
    texts = [prose(x, n, n).encode() for n in (0, 1, 9, 60, 300, 900) for x in ("en", "fr")] + [b"a" * 9]
    texts += [texts[-2][: len(texts[-2]) // 2] + texts[-4][:2000], texts[9][:-1]]
    rank = feature_digest.rarity(feature_digest.level_counts(texts))
    made, want = feature_digest.digests(texts, rank), [brute_digest(t, rank) for t in texts]
    for (filters, last), (chain, n) in zip(made, want, strict=True):
        assert np.unpackbits(filters, axis=1).tolist() == chain and last == (n - (len(chain) - 1) * feature_digest.FILL if n else 0)
    assert max(len(c) for c, _ in want) > 2
    for i in range(len(texts)):
        got = feature_digest.likenesses(made, made[i:] + made[:i])
        assert got == pytest.approx([brute_likeness(x, y) for x, y in zip(want, want[i:] + want[:i], strict=True)], abs=1e-9)


def test_rows_of_one_id_or_none_are_dealt_to_several_tasks(spark):
    docs = spark.createDataFrame([(7, prose("en", 30, i)) for i in range(200)] + [(None, prose("fr", 30, i)) for i in range(200)] + [(9, "last")], "doc_id long, text string")
    first = docs.filter("doc_id = 7").select(F.min(F.struct(F.xxhash64("text"), "text"))).first()[0]["text"]
    got = feature_digest.fingerprints(docs, 4)
    assert got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect().count(0) == 0
    got = got.collect()
    assert len(got) == 401 and sum(r["doc_id"] is None for r in got) == 200
    last = next(r for r in got if r["doc_id"] == 9)
    assert last["edited_sha256"] == hashlib.sha256(feature_digest.edited("last", first).encode()).hexdigest()


def test_fingerprint_rows(spark):
    texts = {i: prose(sorted(WORDS)[i % 4], 1 + 40 * (i % 9), i) for i in range(50)} | {60: None, 61: "", 62: "é" * 41, 63: prose("en", 9000, 3), 64: prose("en", 9000, 3)}
    rows = [*texts.items(), (None, "lost")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int").repartition(5)
    ids = sorted(texts)
    results = []
    for parts in (1, 4):
        got = {r["doc_id"]: r for r in feature_digest.fingerprints(docs, parts).collect()}
        assert len(got) == len(rows)
        for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
            own, new = texts[i] or "", feature_digest.edited(texts[i] or "", texts[following] or "")
            assert got[i]["n_chars"] == len(own) and got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            want = feature_digest.likeness(feature_digest.from_text(got[i]["fingerprint"]), feature_digest.from_text(got[following]["fingerprint"]))
            assert got[i]["near_next"] == pytest.approx(want)
        results.append([tuple(got[i]) for i in [*ids, None]])
    assert results[0] == results[1]
    assert got[63]["fingerprint"] == got[64]["fingerprint"] and got[63]["near_next"] == 1.0
    assert got[60]["fingerprint"] == "" and got[60]["near_next"] == 1.0 and got[59 - 10]["near_next"] == 0.0
    long = [got[i] for i in ids if len(texts[i] or "") > 400 and i not in (63, 64)]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9
    assert feature_digest.fingerprints(docs.limit(0)).count() == 0
    assert feature_digest.fingerprints(docs.filter("doc_id = 5")).first()["near_next"] == 1.0
    assert feature_digest.fingerprints(docs.filter("doc_id is null")).first()["near_next"] == 0.0


def test_edited_text():
    assert feature_digest.edited("abcdef", "XYZW") == "abcXYZ" and feature_digest.edited("abcde", "X") == "abcX" and feature_digest.edited("a", "X") == "a"


def test_only_empty_texts_have_no_features(spark):
    same = ["a" * 1000, "=" * 5000, "ha " * 400, "0123456789" * 100, "buy now " * 200, "e" * 40, "b" * 35, "c" * 31, "d", "é" * 41, "aab" * 300, "xyz" * 11]
    usual = [prose("en", n, n) for n in (60, 300)]
    texts = [t.encode() for t in [*same, "", *usual]]
    rank = feature_digest.rarity(feature_digest.level_counts(texts))
    made = feature_digest.digests(texts, rank)
    assert [len(d[0]) == 0 for d in made] == [not t for t in texts]
    assert len({feature_digest.to_text(d) for d in made}) == len(made)
    assert [d[1] for d in made[:5]] == [1, 1, 3, 10, 8]  # as many as there are different windows
    assert [feature_digest.to_text(feature_digest.digests([t], rank)[0]) for t in texts] == [feature_digest.to_text(d) for d in made]
    for i, x in enumerate(made):
        for j, y in enumerate(made):
            score = feature_digest.likeness(x, y)
            assert score == feature_digest.likenesses([x], [y])[0] and (score == 1.0 if i == j else score < 0.5)
    # Texts in which windows have enough points keep those, and no others.
    for t, d in zip(texts[-2:], made[-2:], strict=True):
        found = {t[i : i + feature_digest.WINDOW] for i in brute_features(t, rank)}
        assert d[1] + feature_digest.FILL * (len(d[0]) - 1) == len(found) > 0
    docs = spark.createDataFrame(list(enumerate([*same, ""])), "doc_id long, text string")
    rows = sorted(feature_digest.fingerprints(docs, 2).collect())
    assert all((r["fingerprint"] == "") == (r["n_chars"] == 0) and r["near_next"] < 0.5 for r in rows)

"""Operator 7, near-duplicate documents by one-permutation hashing.

A document is the set of its word shingles. Documents of one set are one node. Each node's set is sketched with
one permutation and optimal densification, the sketch is cut into bands, and nodes that agree in a band share a
bucket. In every bucket each node is paired with one alone, a star, so pairs grow with the nodes and not with
their square; a pair is a link if the full sets are similar enough. Where a bucket's nodes are not all connected
after that, those outside its largest component could still be similar to others of it. A bucket of over ASKED
nodes is first split by the bands of a second permutation, so that its nodes move BANDS times at most and only
those that agree again meet. Then the open nodes are dealt in blocks of ASKING, their mates in blocks of ASKED, and
each two blocks meet in one task, which returns links alone; a pair is compared only in the first band that it
shares. Bands and rows are chosen so that a pair at the limit is missed with a chance under MISS by each permutation.

Defined results: null texts count as empty; a document without words has no shingle, is linked with nothing and
is its own component. Fewer words than a shingle's are one shingle. component_id is the least doc_id that can
be reached; rows that repeat a doc_id are documents of their own, and share a component if their sets do; a null
doc_id is never the least unless its component has no other. A very long text is shingled as a whole, in one task, in
about forty times its words' number of bytes. Equal sets tie, and are one node. An empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import Scratch, fresh, partitions
from traceloom.llm.components import connected, keyed_join
from traceloom.llm.shingles import band_hashes, shingle_sets, similar, sketches
from traceloom.llm.word_tokens import slices

SHINGLE, PERCENT = 5, 80
BANDS, MISS = 24, 1e-5
ASKING, ASKED, SALT = 512, 4096, 256


def rows_per_band(percent: int, bands: int = BANDS) -> int:
    """The most rows with which a pair at the limit is missed with a chance under MISS."""
    return max(r for r in range(1, 33) if r == 1 or (1 - (percent / 100) ** r) ** bands <= MISS)


def _set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signer(size: int, rows: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, marks, texts = pdf["doc_id"].astype("Int64"), pdf["mark"].to_numpy(), pdf["text"].tolist()
            for a, b in slices(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], size)
                bands = band_hashes(sketches(sets, BANDS * rows), BANDS)
                yield pd.DataFrame(
                    {
                        "doc_id": docs.iloc[a:b].array,
                        "mark": marks[a:b],
                        "n_shingles": [len(s) for s in sets],
                        "node": [_set_key(s) if len(s) else None for s in sets],
                        "bands": [h if len(s) else None for s, h in zip(sets, bands, strict=True)],
                    }
                )

    return sign


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "mark": pdf["mark"], "packed": [squeeze.compress(t.encode()) for t in pdf["text"]]})


def _set_maker(size: int, rows: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor()
        for pdf in batches:
            texts = [expand.decompress(p).decode() for p in pdf["packed"]]
            for a, b in slices(texts, 1_000_000):
                sets = shingle_sets(texts[a:b], size)
                again = band_hashes(sketches(sets, BANDS * rows, 1), BANDS)
                keep = [(n, s.tobytes(), h, g) for n, s, h, g in zip(pdf["node"].iloc[a:b], sets, pdf["bands"].iloc[a:b], again, strict=True) if _set_key(s) == n]
                yield pd.DataFrame(keep, columns=["node", "set", "bands", "again"])

    return make


def _verifier(percent: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by centre, the centre itself first."""
        at, own = None, np.zeros(0, np.uint64)
        for pdf in batches:
            links = []
            for centre, salt, is_centre, node, data in zip(pdf["centre"], pdf["salt"], pdf["is_centre"], pdf["node"], pdf["set"], strict=True):
                s = np.frombuffer(data, np.uint64)
                if is_centre:
                    at, own = (centre, salt), s
                elif at == (centre, salt) and similar(own, s, percent):
                    links.append((centre, node))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return verify


def _block_tester(percent: int):
    def test(rows: list[tuple], band: int, split: int) -> list[tuple[bytes, bytes]]:
        """Links between components. rows: (whether it asks, whether it is minor, node, comp, set, bands, again); split: the band of `again` they share, or -1."""
        asking, asked = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not asking or not asked:
            return []
        names = {c: k for k, c in enumerate(dict.fromkeys(r[3] for r in rows))}
        comp = np.array([names[r[3]] for r in asked])
        minor, nodes = np.array([r[1] for r in asked], bool), [r[2] for r in asked]
        sets, bands, again = [np.frombuffer(r[4], np.uint64) for r in asked], np.stack([r[5] for r in asked]), np.stack([r[6] for r in asked])
        sizes = np.array([len(s) for s in sets])
        links = []
        for _, _, node, c, data, hashes, hashes2 in asking:
            own, mine = np.frombuffer(data, np.uint64), names[c]
            at = np.flatnonzero((comp != mine) & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own))))
            if len(at):
                at = at[(bands[at] == hashes).argmax(1) == band]
            if len(at) and split >= 0:
                at = at[(again[at] == hashes2).argmax(1) == split]
            for k in at:
                # Two minor nodes ask each other; once is enough.
                if comp[k] != mine and (not minor[k] or node < nodes[k]) and similar(own, sets[k], percent):
                    links.append((c, asked[k][3]))
                    comp[comp == comp[k]] = mine
        return links

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, here = None, [], (0, -1)
        for pdf in batches:
            links = []
            for key, band, split, x, y, *row in pdf.itertuples(index=False):
                if (key, x, y) != task:
                    links += test(held, *here)
                    task, held, here = (key, x, y), [], (band, split)
                held.append(row)
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
        if links := test(held, *here):
            yield pd.DataFrame(links, columns=["a", "b"])

    return run


def _open_blocks(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """What the stars leave open, dealt in blocks: the rows of _block_tester(), from placed(key, band, node, comp)."""
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"))
    parts = parts.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("major"), F.sum("size").alias("m"), F.max("size").alias("most"))
    parts = parts.filter("most < m and m > 2").select("key", "major", "m")
    rest = keyed_join(placed, parts, "key").withColumn("minor", F.col("comp") != F.col("major")).drop("major")
    few = rest.filter(F.col("m") <= ASKED).select("key", "band", F.lit(-1).alias("split"), "node", "comp", "minor")
    crowd = keyed_join(rest.filter(F.col("m") > ASKED), sets.select("node", "again"), "node").select("key", "band", "node", "comp", "minor", F.posexplode("again").alias("split", "hash"))
    crowd = crowd.select(F.xxhash64("key", "split", "hash").alias("key"), "band", "split", "node", "comp", "minor")
    rest = few.unionByName(crowd)
    sizes = rest.groupBy("key").agg(F.count_if("minor").alias("asks"), F.count(F.lit(1)).alias("n")).filter("asks > 0 and n > 1")
    sizes = sizes.select("key", F.ceil(F.col("asks") / ASKING).cast("int").alias("xs"), F.ceil(F.col("n") / ASKED).cast("int").alias("ys"))
    rest = keyed_join(rest, sizes, "key")
    x, y = F.pmod(F.xxhash64("node"), "xs").cast("int"), F.pmod(F.xxhash64("node"), "ys").cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asking = rest.filter("minor").select("key", "band", "split", x.alias("x"), every("ys").alias("y"), F.lit(True).alias("asks"), "minor", "node", "comp")
    asked = rest.select("key", "band", "split", every("xs").alias("x"), y.alias("y"), F.lit(False).alias("asks"), "minor", "node", "comp")
    return keyed_join(asking.unionByName(asked), sets, "node").select("key", "band", "split", "x", "y", "asks", "minor", "node", "comp", "set", "bands", "again")


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, first for each row of docs(doc_id, text).

    first(no_id, doc_id, mark) names the least row of its class, rows without doc_id last; it is null without words.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "near"), partitions(spark)
    rows_each = rows_per_band(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = scratch.save(texts.mapInPandas(_signer(size, rows_each), "doc_id long, mark long, n_shingles long, node binary, bands array<long>"), "signed")
    # One row a set; equal sets have equal bands.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min(row).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    postings = nodes.select("node", "n", F.posexplode("bands").alias("band", "hash")).select("node", "n", "band", F.xxhash64("band", "hash").alias("key"))
    # Only what shares a bucket goes on.
    buckets = postings.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = scratch.save(keyed_join(postings, buckets, "key"), "shared")
    # A bucket's centre is the node that shares most over all its buckets: of copies mostly the one they were made from.
    scores = shared.groupBy("node").agg(F.sum("m").alias("score"))
    heads = keyed_join(shared, scores, "node").groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("centre"), F.col("n").alias("centre_n")), F.struct("score", "node")).alias("head"))
    few, many = F.least("n", "head.centre_n"), F.greatest("n", "head.centre_n")
    pairs = keyed_join(shared, heads, "key").filter((F.col("node") != F.col("head.centre")) & (100 * few >= percent * many))
    pairs = pairs.select("head.centre", "node").distinct()

    # Sets of the nodes in buckets, made again from the texts of one document each.
    wanted = shared.select("node").distinct()
    chosen = keyed_join(nodes.select("node", "least", "bands"), wanted, "node").select("node", "bands", F.coalesce("least.doc_id", F.lit(-1)).alias("_id"), F.col("least.mark").alias("_mark"))
    packed = texts.mapInPandas(_packed, "doc_id long, mark long, packed binary").withColumn("_doc", F.coalesce("doc_id", F.lit(-1)))
    # By id and text, so that rows that repeat an id do not meet each other's sets.
    sets = packed.join(chosen, (F.col("_doc") == F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("node", "bands", "packed")
    sets = scratch.save(sets.mapInPandas(_set_maker(size, rows_each), "node binary, set binary, bands array<long>, again array<long>").dropDuplicates(["node"]), "sets")

    # A centre of many pairs is dealt to several tasks, SALT pairs each.
    pairs = scratch.save(pairs, "pairs")
    salts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    bare = sets.select("node", "set")
    members = keyed_join(keyed_join(pairs, salts, "centre").withColumn("salt", F.pmod(F.xxhash64("node"), "salts").cast("int")), bare, "node")
    centres = keyed_join(salts.withColumnRenamed("centre", "node"), bare, "node").select(F.col("node").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_centre"), "node", "set")
    rows = centres.unionByName(members.select("centre", "salt", F.lit(False).alias("is_centre"), "node", "set"))
    rows = rows.repartition(n, "centre", "salt").sortWithinPartitions("centre", "salt", F.desc("is_centre"))
    links = scratch.save(rows.mapInPandas(_verifier(percent), "a binary, b binary"), "links")
    labels = connected(links, scratch, "star")

    placed = keyed_join(shared.select("key", "band", "node"), labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = scratch.save(placed, "placed")
    blocks = _open_blocks(placed, sets).repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y")
    more = scratch.save(blocks.mapInPandas(_block_tester(percent), "a binary, b binary"), "more")
    joined = None
    if not more.isEmpty():
        joined = connected(more, scratch, "all").select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    for done in ("shared", "sets", "pairs", "links", "placed", "more"):
        scratch.drop(done)

    found = keyed_join(nodes.select("node", "least"), labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if joined is not None:
        found = keyed_join(found, joined, "comp", "left").select("node", "least", F.coalesce("whole", "comp").alias("comp"))
    first = found.groupBy("comp").agg(F.min("least").alias("first"))
    found = keyed_join(found, first, "comp").select("node", "first")
    return keyed_join(signed.select("doc_id", "mark", "n_shingles", "node"), found, "node", "left").select("doc_id", "mark", "n_shingles", "first")


def near_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return classes(docs, size, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, with all its columns, with one row of each class: that of the least doc_id, rows without one last.

    Rows are told apart by doc_id and text; of rows that repeat both, one stays. Rows without words all stay.
    """
    id_, mark, extra = fresh(docs, "id", "mark", "extra")
    rows = classes(docs, size, percent).filter("first is not null").groupBy("doc_id", "mark").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("rows"))
    gone = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
    marked = rows.filter(gone | (F.col("rows") > 1)).select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), (~gone).alias(extra))
    marked = Scratch(docs.sparkSession, "near-verdicts").save(marked, "rows")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(mark))
    kept = docs.join(marked.filter(~F.col(extra)), same, "left_anti")
    twice = marked.filter(extra)
    if twice.isEmpty():
        return kept
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))

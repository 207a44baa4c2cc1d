"""The stages of the corpus pipeline on a small table with odd rows."""

import random

import corpus_pipeline
from traceloom.llm.common import Scratch

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def test_stages_take_effect(spark):
    r = random.Random(2)
    words = {"en": "the and of with from this that have which".split(), "fr": "le la les des une est dans pour avec".split()}
    prose = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice("aeiou") * (k % 3) for k in range(n))
    rows = [(i, prose(lang, 60), lang, f"s{i % 4}", 1, None) for i in range(120) for lang in [("en", "fr")[i % 2]]]
    near = rows[10][1].split()
    near[30] = "changed"
    rows += [(500, rows[3][1], "en", "s0", 1, None), (501, rows[3][1], None, None, 1, "x"), (502, " ".join(near), "en", "s1", 1, None), (503, None, "en", "s1", None, None), (504, "", "en", "s1", 0, None), (505, "12 34", "en", "s1", 5, None)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    columns, scratch, seen = docs.columns, Scratch(spark, "stages"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.save(stage(spark, docs, ""), name)
        seen[name] = {x["doc_id"] for x in docs.select("doc_id").collect()}
        if name != "pack_sequences":
            assert docs.columns == columns
    whole = {x[0] for x in rows}
    assert whole - seen["language_id"] == {503, 504, 505}
    assert seen["language_id"] - seen["exact_dedup"] == {3, 500}
    assert seen["exact_dedup"] - seen["near_dedup"] == {502}
    assert seen["source_mix"] < seen["near_dedup"] and len(seen["source_mix"]) > 0.8 * len(seen["near_dedup"])
    assert seen["pack_sequences"] == seen["source_mix"]
    assert {"sequence_id", "offset", "ids_crc32"} <= set(docs.columns)


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "stages").save(stage(spark, docs, ""), "t")
        assert docs.count() == 0

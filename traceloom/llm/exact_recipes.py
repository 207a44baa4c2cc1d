"""Operator 4, exact deduplication by content-defined chunk recipes, DataFrame functions only.

A text is cut where its own characters say so, so that equal passages give equal chunks wherever they
stand. Chunk contents are brought together once, without repetition, to verify that each identifier
stands for one content; after that only recipes, the ordered lists of identifiers, are moved and compared.

Defined results: a null text counts as empty; an empty text has the empty recipe, so all empty texts are
equal. Of equal texts the row with the largest doc_id stays (a null doc_id only if there is no other).
Repeated rows with one doc_id and one text all count in group_size and share their verdict; `deduplicate`
keeps one of them. Equal texts tie, whichever their other columns. A very long text is cut into chunks of at most
MAX_CHUNK characters, and its recipe is far shorter than it is; in scripts without the letters of a cut every chunk has
that length. An empty table gives an empty result. Extra columns of any name are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import fresh

MIN_CHUNK, MAX_CHUNK = 512, 8192
# A cut follows two letters of fixed classes at a word's end and one of a fixed class after it.
CHUNK_RE = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?[acegikmoqsuwyéáóúß][bdfhjlnprtvxzè,.][ \\n][A-Ma-m]|.{{1,{MAX_CHUNK}}}"


def chunks(text: Column) -> Column:
    """The text's chunks in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK_RE), F.lit(0))


def _identifier(chunk: Column, salt: int) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(f"{salt}:"), chunk) if salt else chunk, 256))


def verified_salt(texts: DataFrame, text_col: str = "text") -> int:
    """The first salt under which every identifier stands for one chunk content; contents are compared, not trusted."""
    for salt in range(8):
        store = texts.select(F.explode(chunks(F.coalesce(text_col, F.lit("")))).alias("chunk"))
        store = store.select(_identifier(F.col("chunk"), salt).alias("id"), "chunk").distinct()
        if store.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").isEmpty():
            return salt
    raise RuntimeError("chunk identifiers stay ambiguous")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    salt = verified_salt(texts)
    recipes = texts.select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks(F.col("text")), lambda c: _identifier(c, salt)).alias("recipe")
    )
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # On one column more than the grouping, so that Spark deals both sides anew and can split a hot recipe.
    recipes, groups = recipes.withColumn("_key", F.xxhash64("recipe")), groups.withColumn("_key", F.xxhash64("recipe"))
    return recipes.join(groups, ["_key", "recipe"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns, without the rows that exact_groups drops; of rows that repeat a doc_id and text, one stays."""
    id_, sha, rows = fresh(docs, "id", "sha", "rows")
    verdicts = exact_groups(docs, id_col, text_col).filter("kept").groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.count(F.lit(1)).alias(rows))
    own = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    kept = docs.join(verdicts, docs[id_col].eqNullSafe(F.col(id_)) & (own == F.col(sha)))
    # Only rows that are repeated as wholes are moved again.
    once, repeated = kept.filter(F.col(rows) == 1), kept.filter(F.col(rows) > 1).dropDuplicates([id_col, sha])
    return once.select(*[docs[c] for c in docs.columns]).unionByName(repeated.select(*[docs[c] for c in docs.columns]))

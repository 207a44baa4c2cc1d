"""Looking records up: the newest that fits, by computation; overlays; where a result comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEWEST = ("ts_created", "record_id")


def newest(records: DataFrame, key: list[str], order: tuple[str, ...] = NEWEST, where: Column | None = None) -> DataFrame:
    """The last row of each key by `order` among those that fit. An aggregate: a hot key is reduced before it is moved."""
    rows = records if where is None else records.filter(where)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*records.columns), F.struct(*order)).alias("row"))
    return last.select("row.*")


def newest_first(records: DataFrame, key: list[str], order: tuple[str, ...] = NEWEST, most: int | None = None) -> DataFrame:
    """All rows, errors too, with their place `nth` from the newest on; with `most`, only so many a key."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    out = records.withColumn("nth", nth)
    return out if most is None else out.filter(F.col("nth") <= most)


def memo_predicate(version: str | None = None, body_hash: str | None = None, custom: Column | None = None) -> Column:
    """Which records a step accepts: its version's if it has one, else its code's, else a predicate of its own, else any."""
    if version is not None:
        return F.col("version").eqNullSafe(F.lit(version))
    if body_hash is not None:
        return F.col("body_hash").eqNullSafe(F.lit(body_hash))
    return F.lit(True) if custom is None else custom


def without_dangling(records: DataFrame, children: DataFrame, existing: DataFrame) -> DataFrame:
    """Records all of whose direct children exist. children(record_id, child_record_id), existing(record_id)."""
    here = existing.select(F.col("record_id").alias("child_record_id"))
    broken = children.join(here, "child_record_id", "left_anti").select("record_id").distinct()
    return records.join(broken, "record_id", "left_anti")


def dangling(children: DataFrame, existing: DataFrame) -> DataFrame:
    """record_id, n_dangling: how many children of each record are gone, of those that miss one."""
    here = existing.select(F.col("record_id").alias("child_record_id"))
    return children.join(here, "child_record_id", "left_anti").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_dangling"))


def stored_once(values: DataFrame) -> DataFrame:
    """content_hash, refs, size, first: each value of values(content_hash, size, ref) once, and who refers to it."""
    return values.groupBy("content_hash").agg(F.count(F.lit(1)).alias("refs"), F.max("size").alias("size"), F.min("ref").alias("first"))


def payload_sizes(once: DataFrame) -> DataFrame:
    """size of all references, own_size of what is stored, refs and blobs: one row from stored_once()."""
    return once.agg(F.sum(F.col("size") * F.col("refs")).alias("size"), F.sum("size").alias("own_size"), F.sum("refs").alias("refs"), F.count(F.lit(1)).alias("blobs"))


def record_info(records: DataFrame) -> DataFrame:
    """Records as they are listed: no payload is read, only columns of the record."""
    return records.select("comp_id", "record_id", "short_name", "version", "error", "result_hash", "duration", "own_duration", "cached_duration", "ts_created")


def backlinks(overlay: DataFrame, records: DataFrame) -> DataFrame:
    """comp_id, run_id, carried_as: which runs pinned a computation's records for another, for computations that have records.

    overlay(run_id, comp_id, donor_comp_id).
    """
    links = overlay.select(F.col("donor_comp_id").alias("comp_id"), "run_id", F.col("comp_id").alias("carried_as")).distinct()
    return links.join(records.select("comp_id"), "comp_id", "left_semi")


def with_payload(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """Records with their payload and whether it was found."""
    stored = blobs.select(F.col("content_hash").alias("result_hash"), "payload", F.lit(True).alias("_there"))
    return records.join(stored, "result_hash", "left").withColumn("blob_found", F.coalesce("_there", F.lit(False))).drop("_there")


def readable(records: DataFrame, children: DataFrame, blobs: DataFrame) -> DataFrame:
    """What a lookup may return: no error, all children there, a payload there."""
    sound = without_dangling(records.filter("error is null"), children, records)
    return sound.join(blobs.select(F.col("content_hash").alias("result_hash")), "result_hash", "left_semi")


def find(records: DataFrame, children: DataFrame, blobs: DataFrame, where: Column | None = None) -> DataFrame:
    """The newest readable record of each computation that fits."""
    return newest(readable(records, children, blobs), ["comp_id"], where=where)


def latest(records: DataFrame, version: str | None = None, body_hash: str | None = None, include_errors: bool = False) -> DataFrame:
    where = F.lit(True) if include_errors else F.col("error").isNull()
    for name, value in (("version", version), ("body_hash", body_hash)):
        if value is not None:
            where = where & (F.col(name) == value)
    return newest(records, ["comp_id"], where=where)


def overlaid(found: DataFrame, overlay: DataFrame, records: DataFrame) -> DataFrame:
    """found, with the overlay's donors in place of its rows; a donor that is missing fails the query.

    overlay(comp_id, donor_comp_id, donor_record_id) wins over any predicate and integrity test. Rows keep the
    asked comp_id beside the donor's.
    """
    donors = records.select(*[F.col(c).alias(f"_d_{c}") for c in records.columns])
    pinned = overlay.join(donors, F.col("donor_record_id") == F.col("_d_record_id"), "left")
    missing = F.raise_error(F.concat(F.lit("overlay of "), F.col("comp_id"), F.lit(" names a missing record")))
    pinned = pinned.withColumn("_d_record_id", F.when(F.col("_d_record_id").isNull(), missing).otherwise(F.col("_d_record_id")))
    others = [c for c in records.columns if c != "comp_id"]
    carried = pinned.select("comp_id", *[F.col(f"_d_{c}").alias(c) for c in others], F.col("donor_comp_id"), F.lit("carried").alias("origin"))
    rest = found.join(overlay.select("comp_id"), "comp_id", "left_anti")
    return carried.unionByName(rest.select("comp_id", *others, F.col("comp_id").alias("donor_comp_id"), F.lit("recalled").alias("origin")))


def resolve(asked: DataFrame, found: DataFrame, overlay: DataFrame) -> DataFrame:
    """asked(comp_id, ...) with record_id and origin: carried before recalled before created."""
    pins = overlay.select("comp_id", F.col("donor_record_id").alias("_pin"))
    hits = found.select("comp_id", F.col("record_id").alias("_hit"))
    rows = asked.join(pins, "comp_id", "left").join(hits, "comp_id", "left")
    origin = F.when(F.col("_pin").isNotNull(), "carried").when(F.col("_hit").isNotNull(), "recalled").otherwise("created")
    return rows.withColumn("record_id", F.coalesce("_pin", "_hit")).withColumn("origin", origin).drop("_pin", "_hit")


def result_digest(records: DataFrame) -> DataFrame:
    """By computation and version: counts, durations, and how many different results; several from one version are drift."""
    return records.groupBy("comp_id", "version").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.countDistinct("result_hash").alias("results"),
        F.percentile_approx("duration", [0.5, 0.95]).alias("durations"),
        (F.countDistinct("result_hash") > 1).alias("nondeterministic"),
    )


def child_records(children: DataFrame, records: DataFrame, legacy: DataFrame | None = None) -> DataFrame:
    """record_id, child_index and the child's record: by its pointer, or where that is missing by the older one.

    legacy(record_id, child_index, child_record_id).
    """
    pointers = children.select("record_id", "child_index", "child_record_id")
    if legacy is not None:
        old = legacy.select("record_id", "child_index", F.col("child_record_id").alias("_old"))
        pointers = pointers.join(old, ["record_id", "child_index"], "full").withColumn("child_record_id", F.coalesce("child_record_id", "_old")).drop("_old")
    there = records.select(F.col("record_id").alias("child_record_id"), F.lit(True).alias("found"))
    return pointers.join(there, "child_record_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def inferred_comp_id(comp_id: Column, path: Column) -> Column:
    """A record's computation, from its folder's name where its metadata lack it."""
    return F.coalesce(comp_id, F.nullif(F.regexp_extract(path, "/([0-9a-f]{64})/", 1), F.lit("")))

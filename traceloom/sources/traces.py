"""Event traces: JSON lines of run events and of record events, to and from tables.

Lines that are blank, malformed or no objects are skipped. A file's own order is kept as `ord`, which breaks
ties between equal times; it needs whole files, so traces of foreign origin are read one file a row.
"""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path
from typing import Any

import json
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.schema import TRACE

RUN_OF_PATH = "runs/([^/]+)/[^/]*$"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord, line of text files; blank lines keep their number and are left out."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("ord", "line")).filter(F.trim("line") != "")


def read_trace(spark: SparkSession, path: str | list[str], names: dict[str, str] | None = None) -> DataFrame:
    """Run events of trace files: run_id, ord and the columns of schema.TRACE, with readers' defaults, and the raw line.

    names: for columns that a foreign trace calls otherwise, its names for them; they count where ours are absent.
    """
    event = F.from_json("line", TRACE, {"mode": "PERMISSIVE"})
    for ours, theirs in (names or {}).items():
        kind = next(f.dataType for f in spark.createDataFrame([], TRACE).schema if f.name == ours)
        event = event.withField(ours, F.coalesce(event[ours], F.get_json_object("line", f"$.{theirs}").cast(kind)))
    event = F.when(F.from_json("line", TRACE).isNotNull(), event).alias("event")
    rows = numbered_lines(spark, path).select(F.regexp_extract("file", RUN_OF_PATH, 1).alias("run_id"), F.col("ord").cast("bigint").alias("ord"), "line", event)
    return with_defaults(rows.filter(F.col("event.e").isNotNull()).select("run_id", "ord", "event.*", F.col("line").alias("raw")))


def with_defaults(events: DataFrame) -> DataFrame:
    return events.fillna({"ts": 0.0, "level": "info", "cached": False, "args": ""})


def read_record_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord and raw JSON of record events; a line that is no JSON object is left out."""
    rows = numbered_lines(spark, path).withColumn("parsed", F.try_parse_json("line"))
    return rows.filter(F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))).drop("parsed")


def read_json_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One document a file, as metadata files are; missing files give no row, corrupt ones are dropped."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("file")).filter("_corrupt is null").drop("_corrupt")


def lenient_fields(kwargs: Column) -> list[Column]:
    """A stored trace's fields out of their JSON; what is not of its field's form is null, an absent level is info."""
    at = lambda name: F.get_json_object(kwargs, f"$.{name}")
    cost = F.map_filter(F.from_json(at("cost"), "map<string,string>"), lambda k, v: v.try_cast("double").isNotNull())
    return [
        at("detail").alias("detail"), at("state").alias("state"), F.coalesce(at("level"), F.lit("info")).alias("level"),
        F.transform(F.from_json(at("progress"), "array<string>"), lambda v: v.try_cast("double").cast("int")).alias("progress"),
        F.transform_values(cost, lambda k, v: v.cast("double")).alias("cost"), F.coalesce(at("edge").try_cast("boolean"), F.lit(False)).alias("edge"),
    ]


def run_id_parts(run_id: Column) -> tuple[Column, Column]:
    """(entry, time) of `{entry}-{iso time}`; entries may have hyphens; nulls where the form is another."""
    pattern = r"^(.+)-(\d{4}-\d{2}-\d{2}T[\d:.]+)$"
    entry = F.regexp_extract(run_id, pattern, 1)
    return F.when(entry != "", entry), F.try_to_timestamp(F.nullif(F.regexp_extract(run_id, pattern, 2), F.lit("")))


def event_dict(event: dict[str, Any]) -> dict[str, Any]:
    """An event without its absent fields."""
    return {k: v for k, v in event.items() if v is not None}


def events_as_json(events: DataFrame) -> DataFrame:
    """value: one JSON line an event, absent fields left out."""
    return events.select(F.to_json(F.struct(*[c for c in events.columns if c not in ("raw", "ord", "run_id")])).alias("value"))


class Sink:
    """Takes events one by one; closing is allowed once and more."""

    def emit(self, event: dict[str, Any]) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class NullSink(Sink):
    def emit(self, event: dict[str, Any]) -> None:
        pass


class MemorySink(Sink):
    def __init__(self) -> None:
        self.events: list[dict[str, Any]] = []

    def emit(self, event: dict[str, Any]) -> None:
        self.events.append(event)


class TeeSink(Sink):
    """Hands each event to several sinks, in order."""

    def __init__(self, *sinks: Sink):
        self.sinks = sinks

    def emit(self, event: dict[str, Any]) -> None:
        for s in self.sinks:
            s.emit(event)

    def close(self) -> None:
        for s in self.sinks:
            s.close()


class LineSink(Sink):
    """Appends JSON lines to a file of the driver, each flushed; events after closing are dropped."""

    def __init__(self, path: str | Path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        self.file = open(path, "a", encoding="utf-8")  # noqa: SIM115

    def emit(self, event: dict[str, Any]) -> None:
        if not self.file.closed:
            self.file.write(json.dumps(event_dict(event), default=str) + "\n")
            self.file.flush()

    def close(self) -> None:
        self.file.close()


def events_frame(spark: SparkSession, events: Iterable[dict[str, Any]], run_id: str) -> DataFrame:
    """Driver events as a table, in their order."""
    lines = [(run_id, i, json.dumps(event_dict(e), default=str)) for i, e in enumerate(events)]
    return parsed_events(spark.createDataFrame(lines, "run_id string, ord bigint, raw string"))


def parsed_events(rows: DataFrame) -> DataFrame:
    """run_id, ord, the columns of schema.TRACE and raw, from rows(run_id, ord, raw)."""
    return with_defaults(rows.select("run_id", "ord", F.from_json("raw", TRACE).alias("event"), "raw").select("run_id", "ord", "event.*", "raw"))

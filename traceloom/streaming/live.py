"""Event traces as streams: spans kept up to date, sessions, fan-out to several writers, lines as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from traceloom.functions import formats
from traceloom.operators.inspection import generic_fields
from traceloom.schema import TRACE

SPAN = "run_id string, seq int, ord long, name string, parent_seq int, status string, spawn_ts double, start_ts double, end_ts double, error string"
STATE = "ord long, name string, parent_seq int, status string, spawn_ts double, start_ts double, end_ts double, error string"
KEPT_MS = 3_600_000  # how long after its end a span's state is kept, for events that come late or twice
KNOWN = (*(f.strip().split(" ")[0] for f in TRACE.replace("<kind:string,seq:int,id:int,ids:array<int>>", "").replace("<string,double>", "").split(", ")), "run_id", "ord", "event_time")
KINDS = ("spawn", "start", "end", "error", "cancel")


def read_trace_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Trace files as they arrive; each needs `run_id`, `ord` and `event_time` fields, since files keep no order here."""
    rows = spark.readStream.schema(f"run_id string, ord bigint, event_time timestamp, {TRACE}").option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.filter("e is not null")


def _clean(v):
    return None if v is None or v is pd.NA or v != v else v


def fold_span(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One span's state after a batch of its events, taken in order; what is older than the state is left out."""
    run_id, seq = key
    if state.hasTimedOut:
        state.remove()
        return
    now = dict(zip([c.split()[0] for c in STATE.split(", ")], state.get, strict=True)) if state.exists else None
    events = pd.concat(list(batches)).sort_values("ord")
    for e in events.to_dict("records"):
        e = {k: _clean(v) for k, v in e.items()}
        if now is not None and e["ord"] <= now["ord"]:
            continue
        if e["e"] == "spawn":
            now = {"ord": 0, "name": e["name"] or "?", "parent_seq": e["parent_seq"], "status": "pending", "spawn_ts": e["ts"], "start_ts": None, "end_ts": None, "error": None}
        elif now is None:
            continue
        elif e["e"] == "start":
            now |= {"status": "running", "start_ts": e["ts"]}
        elif e["e"] == "end":
            now |= {"status": "cached" if e["cached"] else "ok", "end_ts": e["ts"]}
        elif e["e"] == "error":
            now |= {"status": "error", "end_ts": e["ts"], "error": e["err"] or "error"}
        else:
            now |= {"status": "cancelled", "end_ts": e["ts"]}
        now["ord"] = e["ord"]
    if now is not None:
        state.update(tuple(now.values()))
        if now["end_ts"] is not None:
            state.setTimeoutDuration(KEPT_MS)
        yield pd.DataFrame([{"run_id": run_id, "seq": seq} | now]).astype({"ord": "int64", "seq": "int32", "parent_seq": "Int32"})


def live_spans(events: DataFrame) -> DataFrame:
    """A row for each span that a batch changed, as it stands after it; for update mode."""
    own = events.filter(F.col("e").isin(*KINDS)).select("run_id", "seq", "ord", "e", "name", "parent_seq", "ts", "cached", "err")
    return own.groupBy("run_id", "seq").applyInPandasWithState(fold_span, SPAN, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def replayed(traces: DataFrame, per_second: int = 10, speed: float = 1.0) -> DataFrame:
    """A stream that gives the rows of traces(offset seconds, ...) again, each as late as its offset at that speed says, to a tick of 1 / per_second."""
    ticks = traces.sparkSession.readStream.format("rate").option("rowsPerSecond", per_second).load()
    due = traces.withColumn("tick", F.floor(F.col("offset") / speed * per_second).cast("bigint"))
    return ticks.select(F.col("value").alias("tick"), F.col("timestamp").alias("told_at")).join(due, "tick").drop("tick")


def live_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Events by kind and window; event_time must be a TIMESTAMP, watermarks take no other."""
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", width), "e").agg(F.count(F.lit(1)).alias("n"))


def live_sessions(events: DataFrame, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(F.session_window("event_time", gap), key).agg(F.count(F.lit(1)).alias("events"))


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events that arrive twice within the watermark, once."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["run_id", "ord"])


def fan_out(stream: DataFrame, writers: list[Callable[[DataFrame, int], None]], checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Hands each batch to all writers, in order, from one computation of it."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for w in writers:
                w(kept, number)
        finally:
            kept.unpersist()

    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(availableNow=True) if available_now else out).start()


def rendered(events: DataFrame) -> DataFrame:
    """run_id, ord, line: trace events as text."""
    others = generic_fields(F.col("raw"), KNOWN) if "raw" in events.columns else F.lit(None).cast("map<string,string>")
    line = formats.trace_line(F.coalesce("msg", F.lit("")), F.col("state"), F.col("progress"), F.col("cost"), others)
    return events.filter("e = 'trace'").select("run_id", "ord", formats.coloured(line, formats.level_colour(F.col("level"))).alias("line"))


def printer(show: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A writer for fan_out that prints a batch's lines; they are as many as arrived since the last."""

    def write(batch: DataFrame, _: int) -> None:
        for row in rendered(batch).orderBy("run_id", "ord").toLocalIterator():
            show(row["line"])

    return write

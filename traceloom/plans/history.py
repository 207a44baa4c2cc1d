"""Runs of steps to and from the record store, so that a later process recalls what an earlier one has made."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.plans.steps import Engine, Handle, MemoryRecords, Record
from traceloom.sources.store import RecordStore
from traceloom.sources.traces import MemorySink, Sink, TeeSink, event_dict


def run_name(entry: str, at: datetime) -> str:
    return f"{entry}-{at.strftime('%Y-%m-%dT%H:%M:%S.%f')}"


def run_and_publish(store: RecordStore, engine: Engine, handle: Handle, entry: str | None = None, overlay: dict[str, str] | None = None, sink: Sink | None = None) -> Any:
    """The run's result; its overlay is in the store before the body runs, its records, steps and state after it, also if it fails."""
    at = datetime.now(UTC).replace(tzinfo=None)
    entry = entry or handle.step.identity
    run_id, events = run_name(entry, at), MemorySink()
    if overlay:
        donors = {d: engine.records.get(d) for d in overlay.values()}
        store.put_rows("overlay_entries", [(run_id, comp, donors[d].comp_id if donors[d] else None, d) for comp, d in overlay.items()])
    made: list[Record] = []
    status = "failed"
    try:
        value = engine.run(handle, overlay=overlay, sink=TeeSink(events, sink) if sink else events, made=made)
        status = "ok"
        return value
    finally:
        _publish(store, made, run_id, entry, at, status, events.events)


def _publish(store: RecordStore, records: list[Record], run_id: str, entry: str, at: datetime, status: str, events: list[dict[str, Any]]) -> None:
    """One batch: rows of this run alone, which the driver has made itself."""
    spark, now = store.spark, datetime.now(UTC).replace(tzinfo=None)
    rows: dict[str, list[tuple]] = {"runs": [(run_id, entry, at, now, status)], "run_steps": [], "records": [], "record_children": [], "record_events": [], "blobs": []}
    names = {e["seq"]: e["name"] for e in events if e["e"] == "spawn"}
    ends = [e for e in events if e["e"] == "end" and e.get("record_id")]
    rows["run_steps"] = [(run_id, n, names.get(e["seq"], f"task-{e['seq']}"), e["comp_id"], e["record_id"], e.get("origin")) for n, e in enumerate(ends, 1)]
    rows["run_events"] = [(run_id, i, json.dumps(event_dict(e), default=str)) for i, e in enumerate(events)]
    for r in records:
        digest = None
        if r.payload is not None:
            digest = hashlib.sha256(r.payload.encode()).hexdigest()
            rows["blobs"].append((digest, r.payload, len(r.payload)))
        rows["records"].append((r.comp_id, r.record_id, r.identity, r.identity.rpartition(".")[2], r.body_hash, r.version, r.error, digest, (r.payload or "")[:200], r.args_repr, r.tags, r.duration, r.own_duration, r.cached_duration, now))
        rows["record_children"] += [(r.comp_id, r.record_id, i, *c) for i, c in enumerate(r.children)]
        rows["record_events"] += [(r.comp_id, r.record_id, i, "trace", t["ts"], t["delta"], None, t["msg"], json.dumps({k: v for k, v in t.items() if k not in ("ts", "delta", "msg")}), None, None) for i, t in enumerate(r.traces)]
    from traceloom.sources.store import TABLES

    store.publish(**{name: spark.createDataFrame(part, TABLES[name]) for name, part in rows.items() if part})


def _loaded(store: RecordStore, records: DataFrame) -> Iterator[Record]:
    """Records with their payloads, children and traces, oldest first, one by one."""
    own = lambda t: store.table(t).join(records.select("record_id"), "record_id", "left_semi")
    children = own("record_children").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("child_index", "child_comp_id", "child_record_id", "short_name", "start_rel", "end_rel"))).alias("children"))
    traces = own("record_events").filter("kind = 'trace'").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("ord", "ts", "delta", "message", "kwargs"))).alias("traces"))
    blobs = store.table("blobs").select(F.col("content_hash").alias("result_hash"), "payload")
    rows = records.join(blobs, "result_hash", "left").join(children, "record_id", "left").join(traces, "record_id", "left")
    for r in rows.orderBy("ts_created", "record_id").toLocalIterator():
        noted = [{"ts": t["ts"], "delta": t["delta"], "msg": t["message"]} | json.loads(t["kwargs"]) for t in r["traces"] or []]
        refs = [tuple(c)[1:] for c in r["children"] or []]
        yield Record(r["comp_id"], r["record_id"], r["identity"], r["body_hash"], r["version"], r["payload"], r["error"], r["duration"], r["own_duration"], r["cached_duration"], r["args_repr"] or {}, noted, refs, r["tags"] or {})


def load_records(store: RecordStore, identities: list[str] | None = None) -> MemoryRecords:
    """Records of the store, of some steps or all, for an engine of this process: as much memory as they take."""
    out = MemoryRecords()
    records = store.table("records")
    if identities is not None:
        records = records.filter(F.col("identity").isin(identities))
    for r in _loaded(store, records):
        out.put(r)
    return out


class StoreRecords(MemoryRecords):
    """Records of a store, read when they are asked for: one computation's stack, or one record, at a time.

    The driver holds what its own run asks for and makes, not the store's history.
    """

    def __init__(self, store: RecordStore):
        super().__init__()
        self.store, self.asked, self.missing = store, set(), set()
        self.reading = threading.Lock()

    def _read(self, where: Column) -> None:
        below: set[str] = set()
        for r in _loaded(self.store, self.store.table("records").filter(where)):
            if r.record_id not in self.by_id:
                self.put(r)
                below |= {c[1] for c in r.children}
        # Their trees too, a level at a time: a hit needs its children, and is told with all below it.
        if below := below - set(self.by_id) - self.missing:
            self._read(F.col("record_id").isin(sorted(below)))
            self.missing |= below - set(self.by_id)
        for stack in self.stacks.values():
            stack.sort(key=lambda r: r.record_id)  # ids sort by time

    def find(self, comp_id: str, fits: Callable[[Record], bool]) -> Record | None:
        with self.reading:
            if comp_id not in self.asked:
                self.asked.add(comp_id)
                self._read(F.col("comp_id") == comp_id)
        return super().find(comp_id, fits)

    def history(self, comp_id: str) -> list[Record]:
        self.find(comp_id, lambda r: True)
        return super().history(comp_id)

    def get(self, record_id: str) -> Record | None:
        with self.reading:
            if record_id not in self.by_id and record_id not in self.missing:
                self._read(F.col("record_id") == record_id)
                if record_id not in self.by_id:
                    self.missing.add(record_id)
        return self.by_id.get(record_id)

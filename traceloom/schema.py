"""Tables of a history. Optional event fields are null where the event has none."""

from __future__ import annotations

RECORDS = (
    "comp_id string, record_id string, identity string, short_name string, body_hash string, version string, error string, "
    "result_hash string, result_repr string, args_repr map<string,string>, tags map<string,string>, duration double, "
    "own_duration double, cached_duration double, ts_created timestamp"
)
CHILDREN = "comp_id string, record_id string, child_index int, child_comp_id string, child_record_id string, short_name string, start_rel double, end_rel double"
RECORD_EVENTS = "comp_id string, record_id string, ord bigint, kind string, ts double, delta double, end_ts double, message string, kwargs string, child_index int, short_name string"
BLOBS = "content_hash string, payload string, size bigint"
RUNS = "run_id string, entry string, started_at timestamp, ended_at timestamp, status string"
RUN_STEPS = "run_id string, ordinal int, name string, comp_id string, record_id string, origin string"
RUN_EVENTS = "run_id string, ord bigint, raw string"
OVERLAYS = "run_id string, comp_id string, donor_comp_id string, donor_record_id string"
TRACE = (
    "e string, ts double, seq int, parent_seq int, name string, origin string, comp_id string, record_id string, record_path string, "
    "identity string, body_hash string, version string, args string, memo boolean, cached boolean, size bigint, own_size bigint, "
    "duration double, own_duration double, cached_duration double, on struct<kind:string,seq:int,id:int,ids:array<int>>, on_seq int, "
    "msg string, detail string, progress array<int>, state string, level string, cost map<string,double>, edge boolean, err string"
)
# The kinds of run events, and how much each status of a span weighs against others.
EVENT_KINDS = ("spawn", "start", "end", "wait", "resume", "trace", "error", "cancel")
STATUS_WEIGHT = {"error": 5, "running": 3, "pending": 2, "cancelled": 1, "ok": 0, "cached": 0}

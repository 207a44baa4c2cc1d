"""Streams against the batch operators on the same events."""

import json
import random

from pyspark.sql import functions as F

from traceloom.operators import spans
from traceloom.sources.traces import with_defaults
from traceloom.streaming import live


def write_events(folder, n_files=3):
    r = random.Random(7)
    events, ord_ = [], 0
    for run in ("a", "b"):
        for seq in range(1, 9):
            kinds = ["spawn", "start", r.choice(["end", "error", "cancel", None])]
            for k in [k for k in kinds if k][: r.choice([1, 2, 3, 3])]:
                events.append({"run_id": run, "seq": seq, "e": k, "ts": float(ord_), "name": f"n{seq}" if k == "spawn" else None, "parent_seq": seq // 2 or None if k == "spawn" else None, "cached": bool(seq % 2), "err": "bad" if k == "error" else None})
                ord_ += 1
        events.append({"run_id": run, "parent_seq": 1, "e": "trace", "ts": float(ord_), "msg": f"hello {run}", "level": "warn"})
        ord_ += 1
    for i, e in enumerate(events):
        e |= {"ord": i, "event_time": f"2024-01-01T00:{i:02d}:00Z"}
    folder.mkdir()
    for k in range(n_files):
        part = events[k * len(events) // n_files : (k + 1) * len(events) // n_files]
        (folder / f"{k}.json").write_text("".join(json.dumps({a: b for a, b in e.items() if b is not None}) + "\n" for e in part))
    return events


def test_live_spans_end_as_the_batch_ones(spark, tmp_path):
    write_events(tmp_path / "in")
    stream = live.live_spans(live.read_trace_stream(spark, f"file://{tmp_path}/in", files_per_trigger=1))
    rows = []
    query = live.fan_out(stream, [lambda df, i: rows.extend((i, *x) for x in df.collect())], f"file://{tmp_path}/cp", mode="update")
    query.awaitTermination(120)
    latest = {}
    for x in sorted(rows, key=lambda x: x[0]):
        latest[x[1], x[2]] = (x[4], x[5], x[6], x[7], x[8], x[9], x[10])
    batch = spark.read.schema(live.read_trace_stream(spark, f"file://{tmp_path}/in").schema).json(f"file://{tmp_path}/in")
    want = spans.reduce_spans(with_defaults(batch)).select("run_id", "seq", "name", "parent_seq", "status", "spawn_ts", "start_ts", "end_ts", "error")
    assert latest == {(r[0], r[1]): tuple(r)[2:] for r in want.collect()}


def test_counts_lines_and_duplicates(spark, tmp_path):
    events = write_events(tmp_path / "in")
    (tmp_path / "in" / "again.json").write_text((tmp_path / "in" / "0.json").read_text())
    stream = live.read_trace_stream(spark, f"file://{tmp_path}/in")
    seen, lines = [], []
    query = live.fan_out(live.once_each(stream), [lambda df, _: seen.append(df.count()), live.printer(lines.append)], f"file://{tmp_path}/cp")
    query.awaitTermination(120)
    assert sum(seen) == len(events) and len(lines) == 2 and "hello a" in lines[0]
    counted = []
    live.fan_out(live.live_counts(stream, width="10 minutes"), [lambda df, _: counted.append(df.groupBy("e").agg(F.sum("n").alias("n")).collect())], f"file://{tmp_path}/cp2", mode="complete").awaitTermination(120)
    assert {r["e"]: r["n"] for r in counted[-1]}["trace"] == 2

"""Set-based operators against plain Python on small tables."""

import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traceloom.functions import formats, versions
from traceloom.operators import clock, inspection, lifecycle, lookup, memo_map, spans
from traceloom.sources import traces
from traceloom.sources.store import RecordStore

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def records(spark, rows):
    return spark.createDataFrame(rows, "comp_id string, record_id string, version string, body_hash string, error string, result_hash string, ts_created int")


@pytest.fixture(scope="module")
def stack(spark):
    return records(spark, [("k", "1", "v1", "a", None, "h1", 1), ("k", "2", "v2", "b", None, "h2", 2), ("k", "3", "v3", "b", "boom", None, 3), ("m", "4", None, "a", None, "gone", 4)])


def test_newest_with_filters(stack):
    one = lambda df: {r["comp_id"]: r["record_id"] for r in df.collect()}
    assert one(lookup.latest(stack)) == {"k": "2", "m": "4"}
    assert one(lookup.latest(stack, include_errors=True)) == {"k": "3", "m": "4"}
    assert one(lookup.latest(stack, version="v1")) == {"k": "1"}
    assert one(lookup.newest(stack, ["comp_id"], where=lookup.memo_predicate(body_hash="a"))) == {"k": "1", "m": "4"}
    assert one(lookup.newest(stack, ["comp_id"], where=lookup.memo_predicate(custom=F.col("record_id") < "2"))) == {"k": "1"}
    assert [r["record_id"] for r in lookup.newest_first(stack, ["comp_id"], most=2).filter("comp_id = 'k'").orderBy("nth").collect()] == ["3", "2"]


def test_find_needs_children_and_payload(spark, stack):
    blobs = spark.createDataFrame([("h1", "{}"), ("h2", "{}")], "content_hash string, payload string")
    children = spark.createDataFrame([("2", "9"), ("1", "4")], "record_id string, child_record_id string")
    assert {r["comp_id"]: r["record_id"] for r in lookup.find(stack, children, blobs).collect()} == {"k": "1"}
    assert {r["record_id"]: r["blob_found"] for r in lookup.with_payload(stack, blobs).collect()} == {"1": True, "2": True, "3": False, "4": False}


def test_overlay_wins_keeps_the_donor_and_fails_loudly(spark, stack):
    found = lookup.latest(stack)
    pins = spark.createDataFrame([("k", "m", "4"), ("new", "k", "1")], "comp_id string, donor_comp_id string, donor_record_id string")
    got = {r["comp_id"]: (r["record_id"], r["donor_comp_id"], r["origin"]) for r in lookup.overlaid(found, pins, stack).collect()}
    assert got == {"k": ("4", "m", "carried"), "new": ("1", "k", "carried"), "m": ("4", "m", "recalled")}
    asked = spark.createDataFrame([("k",), ("m",), ("x",)], "comp_id string")
    assert {r["comp_id"]: r["origin"] for r in lookup.resolve(asked, found, pins).collect()} == {"k": "carried", "m": "recalled", "x": "created"}
    with pytest.raises(Exception, match="missing record"):
        lookup.overlaid(found, pins.withColumn("donor_record_id", F.lit("none")), stack).collect()


EVENTS = [
    {"e": "spawn", "ts": 0.0, "seq": 1, "name": "root"}, {"e": "start", "ts": 0.1, "seq": 1}, {"e": "spawn", "ts": 0.2, "seq": 2, "parent_seq": 1, "name": "a"},
    {"e": "wait", "ts": 0.3, "seq": 1, "on": {"kind": "span", "seq": 2}}, {"e": "start", "ts": 0.3, "seq": 2}, {"e": "trace", "ts": 0.4, "parent_seq": 2, "msg": "m", "cost": {"usd": 0.5}, "progress": [1, 4]},
    {"e": "trace", "ts": 0.4, "parent_seq": 77, "msg": "lost"}, {"e": "end", "ts": 1.0, "seq": 99, "cached": False}, {"e": "error", "ts": 1.0, "seq": 2, "err": "bad", "duration": 0.7},
]


def test_spans_are_as_their_last_events(spark):
    events = traces.events_frame(spark, EVENTS, "r")
    got = {r["seq"]: r for r in spans.reduce_spans(events).collect()}
    assert set(got) == {1, 2} and got[1]["status"] == "running" and got[2]["status"] == "error" and got[2]["error"] == "bad" and got[2]["duration"] == 0.7
    assert spans.own_traces(events, spans.reduce_spans(events)).count() == 1
    waits = spans.open_waits(events)
    assert [(r["seq"], r["target"]) for r in waits.collect()] == [(1, 2)]
    assert spans.open_waits(events, legacy=True).count() == 0
    assert {r["seq"]: r["effective"] for r in spans.effective_status(spans.reduce_spans(events), waits).collect()} == {1: "error", 2: "error"}
    again = traces.events_frame(spark, [*EVENTS, {"e": "resume", "ts": 1.1, "seq": 1, "on_seq": 2}, {"e": "spawn", "ts": 2.0, "seq": 2, "name": "b"}], "r")
    assert spans.open_waits(again).count() == 0
    assert {r["seq"]: (r["status"], r["name"]) for r in spans.reduce_spans(again).collect()}[2] == ("pending", "b")


def test_waiting_in_circles_runs_and_unknown_targets_are_pending(spark):
    own = spark.createDataFrame([("r", i, "running") for i in range(8)] + [("r", 8, "ok"), ("r", 9, "error")], "run_id string, seq int, status string")
    waits = [("r", 0, "span", 1, None), ("r", 1, "span", 2, None), ("r", 2, "span", 0, None), ("r", 3, "span", 4, None), ("r", 4, "span", 8, None), ("r", 5, "span", 50, None), ("r", 6, "group", None, [8, 9, 4]), ("r", 7, "group", None, [])]
    frame = spark.createDataFrame(waits, "run_id string, seq int, kind string, target int, ids array<int>")
    got = {r["seq"]: r["effective"] for r in spans.effective_status(own, frame).collect()}
    assert got == {0: "running", 1: "running", 2: "running", 3: "ok", 4: "ok", 5: "pending", 6: "error", 7: "ok", 8: "ok", 9: "error"}


@QUICK
@given(st.integers(2, 30), st.randoms())
def test_closure_equals_walking_up(spark, n, r):
    up = {i: r.randrange(i) for i in range(1, n)}
    edges = spark.createDataFrame(list(up.items()), "child int, parent int")
    want = set()
    for i in range(n):
        at, far = i, 0
        while True:
            want.add((at, i, far))
            if at not in up:
                break
            at, far = up[at], far + 1
    assert {tuple(x) for x in spans.closure(edges).collect()} == want
    roots = spark.createDataFrame([(0,)], "node int")
    assert {tuple(x) for x in spans.depths(edges, roots).collect()} == {(i, far) for a, i, far in want if a == 0}


def test_long_chains_take_few_rounds(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(150)], "child int, parent int")
    assert spans.closure(edges).count() == 151 * 152 // 2


def test_costs_roll_up(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 3)], "child int, parent int")
    costs = spark.createDataFrame([(1, {"usd": 1.0}), (4, {"usd": 2.0, "n": 5.0}), (4, {"usd": 1.0}), (2, None)], "node int, cost map<string,double>")
    got = {(r["anc"], r["key"]): r["amount"] for r in spans.rolled_cost(costs, spans.closure(edges)).collect()}
    assert got == {(1, "usd"): 4.0, (1, "n"): 5.0, (3, "usd"): 3.0, (3, "n"): 5.0, (4, "usd"): 3.0, (4, "n"): 5.0}


@QUICK
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 20)), min_size=1, max_size=12))
def test_active_time_is_the_union_of_intervals(spark, intervals):
    marks = [(1, a, 1) for a, _ in intervals] + [(1, a + n, -1) for a, n in intervals]
    frame = spark.createDataFrame([(k, t, s, i) for i, (k, t, s) in enumerate(marks)], "k int, t int, s int, i int")
    got = spans.active_time(frame, ["k"], "t", "s", ["t", "s", "i"]).first()["active"]
    assert got == len({x for a, n in intervals for x in range(a, a + n)})


def test_stitching_repeats_shared_children_and_survives_cycles(spark):
    rows = [("r", 0, "a"), ("r", 1, "b"), ("a", 0, "s"), ("b", 0, "s"), ("s", 0, "r")]
    children = spark.createDataFrame(rows, "record_id string, child_index int, child_record_id string")
    got = [tuple(x)[:4] for x in spans.stitch(children, "r", 10).orderBy("seq").collect()]
    assert got == [(10, None, "r", 0), (11, 10, "a", 1), (12, 11, "s", 2), (13, 10, "b", 1), (14, 13, "s", 2)]


def test_stitch_query_covers_every_tree_to_its_leaves(spark):
    from traceloom.queries import stitch, tree_edges

    sf = "/root/testdata/sf0.001"
    below = {}
    for child, parent in sorted(map(tuple, tree_edges(spark, sf).collect())):
        below.setdefault(parent, []).append(child)
    want = []
    for (key,) in spark.read.parquet(f"{sf}/region.parquet").select("r_regionkey").collect():
        seq, todo = 0, [(f"r{key}", None, 0)]
        while todo:
            node, up, depth = todo.pop()
            seq += 1
            want.append((f"r{key}", seq, up, node, depth))
            todo += [(child, seq, depth + 1) for child in reversed(below.get(node, []))]
    got = stitch(spark, sf).select("root", "seq", "parent_seq", "record_id", "depth").collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])
    assert {r[3][0] for r in want} == set("rncol")


def test_recalled_time_in_turn_and_together(spark):
    spawn = lambda seq, up=None: {"e": "spawn", "seq": seq, "parent_seq": up}
    end = lambda seq: {"e": "end", "seq": seq, "cached": True, "duration": 2.0, "cached_duration": 1.0}
    resume = lambda on: {"e": "resume", "seq": 1, "on_seq": on}
    serial = [spawn(1), spawn(2, 1), end(2), resume(2), spawn(3, 1), end(3), resume(3)]
    together = [spawn(1), spawn(2, 1), spawn(3, 1), end(2), end(3), resume(2), resume(3)]
    for events, total in ((serial, 6.0), (together, 3.0)):
        frame = traces.events_frame(spark, events, "r")
        assert {r["seq"]: r["cached_duration"] for r in clock.cached_durations(frame).collect()}[1] == total


def test_runs_retention_and_collection(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/store")
    day = lambda d: datetime(2024, 1, d)
    store.put_rows("runs", [("r1", "e", day(1), None, "ok"), ("r2", "e", day(2), None, "failed"), ("r3", "f", day(1), None, "ok")])
    store.put_rows("run_steps", [("r1", 1, "a", "k1", "1", "created"), ("r2", 1, "b", "k2", "2", "created"), ("r3", 1, "c", "k1", "1", "recalled")])
    rec = lambda comp, rid, blob: (comp, rid, "i", "i", "h", None, None, blob, "", {}, {}, 1.0, 1.0, 0.0, day(1))
    store.put_rows("records", [rec("k1", "1", "x"), rec("k2", "2", "y"), rec("k3", "3", "x"), rec("k4", "4", "z")])
    store.put_rows("record_children", [("k1", "1", 0, "k3", "3", "c", 0.0, 1.0), ("k3", "3", 0, "k1", "1", "loop", 0.0, 1.0)])
    store.put_rows("blobs", [("x", "{}", 2), ("y", "{}", 2), ("z", "{}", 2)])
    store.put_rows("blobs", [("x", "{}", 2)])
    assert store.table("blobs").count() == 3
    listed = {r["run_id"]: (r["is_latest"], r["is_latest_ok"], r["steps"]) for r in store.runs().collect()}
    assert listed == {"r1": (False, True, 1), "r2": (True, False, 1), "r3": (True, True, 1)}
    assert {r["comp_id"] for r in store.find().collect()} == {"k1", "k2", "k3", "k4"}
    assert store.remove_runs("2024-01-02 00:00:00") == ["r1"]
    assert {r["content_hash"] for r in store.collect().collect()} == {"z"}
    assert {r["record_id"] for r in store.table("records").collect()} == {"1", "2", "3"}
    assert store.record("1").first()["payload"] == "{}" and store.history("k1").count() == 1
    assert store.remove_runs("2025-01-01 00:00:00", keep_latest=False) and {r["content_hash"] for r in store.collect().collect()} == {"x", "y"}
    (tmp_path / "store/batches/00000000000000000001-half/records").mkdir(parents=True)
    assert store.table("records").count() == 0 and store.abandon_stale() == 1


def test_a_rewrite_that_dies_leaves_one_store(spark, tmp_path, monkeypatch):
    from traceloom.sources import store as module

    store = RecordStore(spark, f"file://{tmp_path}/store")
    store.put_rows("runs", [("r1", "e", datetime(2024, 1, 1), None, "ok"), ("r2", "f", datetime(2024, 1, 2), None, "ok")])
    store.put_rows("run_steps", [("r1", 1, "a", "k1", "1", "created"), ("r2", 1, "b", "k2", "2", "created")])
    rec = lambda comp, rid, blob: (comp, rid, "i", "i", "h", None, None, blob, "", {}, {}, 1.0, 1.0, 0.0, datetime(2024, 1, 1))
    store.put_rows("records", [rec("k1", "1", "x"), rec("k2", "2", "y"), rec("k3", "3", "z")])
    store.put_rows("blobs", [("x", "{}", 2), ("y", "{}", 2), ("z", "{}", 2)])
    monkeypatch.setattr(module, "delete_path", lambda *_: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        store.collect()
    monkeypatch.undo()
    assert store.table("records").count() == 2 and store.table("runs").count() == 2 and len(store.files.names("batches")) == 5
    monkeypatch.setattr(module, "STALE_SECONDS", -1)
    assert store.abandon_stale() == 4 and store.table("records").count() == 2
    monkeypatch.undo()
    written = store._write
    monkeypatch.setattr(store, "_write", lambda *a, **b: (written(*a, **b), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        store.remove_run("r1")
    monkeypatch.undo()
    assert store.table("runs").count() == 2  # died before its manifest: nothing has changed
    assert store.remove_run("r1") and not store.remove_run("r1") and not store.remove_run("none") and store.table("run_steps").count() == 1
    assert store.remove_entry("f") and store.collect().count() == 2 and store.newest_run() is None
    assert store.files.names("leases") == [] and len([n for n in store.files.names("manifests") if n.endswith("json")]) <= 2


def test_publishers_share_and_a_rewrite_is_alone(spark, tmp_path, monkeypatch):
    import threading
    import time

    from traceloom.sources import store as module

    store = RecordStore(spark, f"file://{tmp_path}/store")
    with store.shared(), store.shared():
        with pytest.raises(TimeoutError), store.exclusive(wait=0.1):
            pass
    order = []

    def rewrite():
        with store.exclusive():
            order.append("rewrite")

    with store.shared():
        waiting = threading.Thread(target=rewrite)
        waiting.start()
        while len(store.files.names("leases")) < 2:
            time.sleep(0.01)
        with pytest.raises(TimeoutError), store.shared(wait=0.1):  # who comes after a rewrite waits for it
            pass
        order.append("shared")
    waiting.join()
    assert order == ["shared", "rewrite"]
    monkeypatch.setattr(module, "STALE_SECONDS", 0.5)
    store.files.write("leases/exclusive-00000000000000000001-dead", "")
    time.sleep(1.1)
    with store.exclusive(wait=0.2):  # a holder that died is no holder; one that works renews its lease
        own = store.files.names("leases")
        time.sleep(1.2)
        assert len(own) == 1 and store.files.age(f"leases/{own[0]}") < 1.2
        with pytest.raises(TimeoutError), store.shared(wait=0.1):
            pass
    threads = [threading.Thread(target=store.put_rows, args=("overlay_entries", [(f"r{i}", "a", "b", "c")])) for i in range(4)]
    monkeypatch.undo()
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.table("overlay_entries").count() == 4


def test_sums_and_flags_of_a_forest_equal_those_of_its_pairs(spark):
    r = random.Random(8)
    up = {i: r.randrange(max(0, i - 3), i) for i in range(1, 60) if i % 13}
    edges = spark.createDataFrame(list(up.items()), "child int, parent int")
    own = spark.createDataFrame([(r.randrange(60), r.choice("ab"), r.randrange(9)) for _ in range(80)], "node int, key string, amount int")
    pairs = spans.closure(edges)
    alone = own.join(pairs.select(F.col("anc").alias("node")).distinct(), "node", "left_anti").groupBy(F.col("node").alias("anc"), "key").agg(F.sum("amount").alias("amount"))
    want = {tuple(x) for x in spans.roll_up(own, pairs).select("anc", "key", "amount").union(alone).collect()}
    assert {tuple(x) for x in spans.roll_up_tree(own, edges).select("anc", "key", "amount").collect()} == want
    flagged = own.filter("amount = 1").select("node")
    assert {x["anc"] for x in spans.flagged_tree(flagged, edges).collect()} == {x["anc"] for x in spans.above_flagged(flagged, pairs).collect()} | {x["node"] for x in flagged.collect()}
    labels = spark.createDataFrame([(i, f"l{i}") for i in range(60)], "node int, label string")
    assert spans.refreshed_labels(flagged, edges, labels).count() == spans.flagged_tree(flagged, edges).count()
    assert spans.roll_up_tree(own.limit(0), edges).count() == 0 and spans.roll_up_tree(own, edges.limit(0)).count() == own.select("node", "key").distinct().count()


def test_reach_over_cycles_and_numbers_without_one_task(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8), (4, None)], "src int, dst int")
    roots = spark.createDataFrame([(1,), (7,)], "node int")
    assert {r["node"] for r in lifecycle.reachable(roots, edges).collect()} == {1, 2, 3, 4, 7}
    rows = spark.createDataFrame([(k, [i // 7, i % 7]) for k in ("a", "b", None) for i in range(40)], "k string, path array<int>").repartition(5)
    got = spans.in_order(rows, "k", "path", "n").collect()
    assert len(got) == 120 and all(r["n"] == r["path"][0] * 7 + r["path"][1] + 1 for r in got)


def test_questions_about_runs(spark):
    events = traces.events_frame(spark, [*EVENTS, {"e": "trace", "ts": 1.0, "parent_seq": 2, "msg": "x", "edge": True, "who": "me", "n": 3}], "r")
    assert inspection.edge_notes(events, "a").count() == 1 and inspection.edge_notes(events, "root").count() == 0
    assert inspection.child_events(events, 1, "wait").count() == 1 and inspection.child_events(events, 2, "trace").count() == 2
    named = {r["name"]: (r["seq"], r["end_ts"], r["cached"]) for r in inspection.first_named(events).collect()}
    assert named == {"root": (1, None, False), "a": (2, 1.0, False)}
    assert inspection.children(spans.reduce_spans(events), 1).first()["seq"] == 2
    assert inspection.fan_out(events).first()["spawned"] == 1 and inspection.executions(events).first()["executions"] == 2
    assert inspection.first_time(events, "run_id").first()["began"] == 0.1
    from traceloom.streaming.live import rendered

    assert [r["line"] for r in rendered(events).orderBy("ord").collect()][-1] == "\x1b[2mx (who=me n=3)\x1b[0m"
    one = spark.range(1).select(formats.styled_trace(F.lit("m"), F.lit("ok"), F.array(F.lit(1), F.lit(2)), F.lit(None).cast("map<string,double>"), F.lit(None).cast("map<string,string>"), F.lit("warn")).alias("t")).first()
    assert one["t"] == "\x1b[33mm (1/2) [ok]\x1b[0m"


def test_foreign_names_of_trace_fields(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"e":"end","seq":1,"their_id":"k1","w":true}\n{"e":"end","seq":2,"comp_id":"k2","their_id":"no"}\nbad\n')
    rows = traces.read_trace(spark, f"file://{tmp_path}/t.jsonl", {"comp_id": "their_id", "cached": "w"}).orderBy("ord").collect()
    assert [(r["comp_id"], r["cached"]) for r in rows] == [("k1", True), ("k2", False)]


def test_memo_map_with_a_column_for_a_body(spark):
    args = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    old = spark.createDataFrame([("1", "a", "one", None, 1)], "comp_id string, record_id string, result string, error string, ts_created int")
    out, fresh = memo_map.memo_map(args, F.col("x").cast("string"), old, F.col("x") * 10)
    assert sorted((r["x"], r["result"], r["origin"]) for r in out.collect()) == [(1, "one", "recalled"), (2, "20", "created"), (2, "20", "created")]
    assert fresh.count() == 1 and "Python" not in out._jdf.queryExecution().toString()


def test_memo_map_computes_misses_once_and_keeps_errors(spark):
    args = spark.createDataFrame([(1,), (2,), (2,), (3,), (4,)], "x int")
    old = spark.createDataFrame([("1", "a", "one", None, 1), ("1", "b", "uno", None, 2), ("1", "c", None, "late error", 3)], "comp_id string, record_id string, result string, error string, ts_created int")
    pins = spark.createDataFrame([("3", "pinned")], "comp_id string, result string")

    def body(row):
        if row["x"] == 4:
            raise ValueError("four")
        return f"new {row['x']}"

    out, fresh = memo_map.memo_map(args, F.col("x").cast("string"), old, body, pins)
    got = sorted((r["x"], r["result"], r["error"], r["origin"]) for r in out.collect())
    assert got == [(1, "uno", None, "recalled"), (2, "new 2", None, "created"), (2, "new 2", None, "created"), (3, "pinned", None, "carried"), (4, None, "ValueError: four", "created")]
    assert fresh.count() == 2 and memo_map.new_record_ids(2)[0][14] == "7"


def test_traces_skip_what_is_no_event(spark, tmp_path):
    folder = tmp_path / "runs" / "my-entry-2024-05-06T07:08:09"
    folder.mkdir(parents=True)
    (folder / "trace.jsonl").write_text('{"e":"spawn","seq":1,"ts":1.5,"name":"a","odd":3}\n\nnot json\n[1]\n{"e":"end","seq":1}\n')
    rows = traces.read_trace(spark, f"file://{folder}/trace.jsonl").orderBy("ord").collect()
    assert [(r["run_id"], r["ord"], r["e"], r["ts"], r["cached"]) for r in rows] == [("my-entry-2024-05-06T07:08:09", 0, "spawn", 1.5, False), ("my-entry-2024-05-06T07:08:09", 4, "end", 0.0, False)]
    assert "odd" in rows[0]["raw"]
    assert traces.read_record_events(spark, f"file://{folder}/trace.jsonl").count() == 2
    entry, at = traces.run_id_parts(F.col("id"))
    got = spark.createDataFrame([(folder.name,), ("latest",)], "id string").select(entry.alias("e"), at.alias("t")).collect()
    assert got[0]["e"] == "my-entry" and got[0]["t"] == datetime(2024, 5, 6, 7, 8, 9) and got[1]["e"] is None and got[1]["t"] is None
    sink = traces.TeeSink(traces.MemorySink(), traces.LineSink(tmp_path / "out.jsonl"))
    sink.emit({"e": "start", "seq": 1, "msg": None})
    sink.close()
    sink.emit({"e": "late"})
    assert (tmp_path / "out.jsonl").read_text() == '{"e": "start", "seq": 1}\n'


def test_versions_order_and_ranges(spark):
    ordered = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0", "2.0.0"]
    shuffled = random.Random(1).sample(ordered, len(ordered))
    frame = spark.createDataFrame([(v,) for v in [*shuffled, "1.2", "x", None]], "v string")
    assert [r["v"] for r in frame.filter("v is not null and v not in ('1.2', 'x')").orderBy(versions.parsed(F.col("v"))).collect()] == ordered
    hits = lambda spec: {r["v"] for r in frame.filter(versions.satisfies(F.col("v"), spec)).collect()}
    assert hits(">=1.2.0,<2.0.0") == {"1.2.0", "1.10.0"} and hits("==1.0.0") == {"1.0.0"} and "1.0.0-rc.1" in hits("!=1.0.0")
    with pytest.raises(ValueError):
        versions.satisfies(F.col("v"), ">=one")


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert one(formats.shortened(lit("x" * 31))) == "x" * 27 + "..." and one(formats.preview(lit(" a\nb "))) == "a b"
    assert [one(formats.duration(lit(v))) for v in (0.0123, 0.5, 1.0, 61.26)] == ["12ms", "500ms", "1.0s", "61.3s"]
    assert [one(formats.age(lit(v))) for v in (5.0, 65.0, 7300.0)] == ["5s", "1m", "2h"]
    assert one(formats.duration_suffix(lit(1.0), lit(2.0))) == "3.0s (2.0s cached)" and one(formats.duration_suffix(lit(None).cast("double"), lit(1.0))) == ""
    assert one(formats.safe_name(lit("a/b\\c d"))) == "a.b.c_d"
    assert one(formats.flattened_content(lit('[{"type":"text","text":"a"},{"type":"image","n":1}]'))) == 'a\n{"type":"image","n":1}'
    assert one(formats.flattened_content(lit('"plain"'))) == "plain"
    costs = F.create_map(lit("usd"), lit(0.25), lit("n"), lit(3.0))
    line = formats.trace_line(lit("go"), lit("running"), F.array(lit(1), lit(0)), costs, lit(None).cast("map<string,string>"))
    assert one(line) == "[░░░░░░░░░░] go (1/0) [running] {usd=0.25 n=3}"
    for v in (0.0, 1.0, 1.5, 1234567.0, 0.00001234, 999999.5, 0.1, 12.3456789, -3.25):
        assert one(formats.number(lit(v))) == f"{v:g}"

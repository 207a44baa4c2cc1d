"""Runs that go through the store and back."""

import pytest

from traceloom.cli import main
from traceloom.operators import lookup
from traceloom.plans.history import StoreRecords, load_records, run_and_publish
from traceloom.plans.steps import Engine, step, trace
from traceloom.sources.store import RecordStore

CALLS = []


@step(memo=True)
def part(i):
    CALLS.append(i)
    trace("working", progress=(i, 3), cost={"usd": 0.5})
    if i == 2 and CALLS.count(2) == 1:
        raise RuntimeError("first time")
    return {"i": i, "t": (i, None)}


@step(memo=True, tags={"kind": "whole"})
def whole(n):
    return [part(i).result() for i in range(n)]


def test_a_later_process_resumes(spark, tmp_path, capsys):
    store = RecordStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(RuntimeError):
        run_and_publish(store, Engine(), whole(3), "entry")
    fresh = Engine(records=load_records(store))
    assert run_and_publish(store, fresh, whole(3), "entry") == [{"i": i, "t": (i, None)} for i in range(3)]
    assert CALLS == [0, 1, 2, 2]
    again = Engine(records=load_records(store, [whole.identity, part.identity]))
    assert run_and_publish(store, again, whole(3), "entry") == [{"i": i, "t": (i, None)} for i in range(3)] and len(CALLS) == 4
    runs = {r["run_id"]: r for r in store.runs().collect()}
    assert len(runs) == 3 and sum(r["is_latest"] for r in runs.values()) == 1 and sorted(r["status"] for r in runs.values()) == ["failed", "ok", "ok"]
    assert store.table("records").filter("error is not null").count() == 2
    assert store.find().filter("identity like '%whole'").count() == 1
    before = store.table("records").count()
    store.collect()
    assert store.table("records").count() == before - 2  # no run refers to failures
    donor = again.records.find(part.comp_id(again, 0), lambda r: True)
    key = part.comp_id(again, 1)
    assert run_and_publish(store, again, part(1), overlay={key: donor.record_id})["i"] == 0
    assert store.table("overlay_entries").count() == 1
    store.view()
    assert spark.sql("select count(*) as n from run_steps where origin = 'carried'").first()["n"] == 1
    assert main(["list", f"file://{tmp_path}/s"]) == 0 and "entry" in capsys.readouterr().out
    assert main(["output", f"file://{tmp_path}/s", donor.record_id]) == 0 and "value 0: " in capsys.readouterr().out
    assert main(["output", f"file://{tmp_path}/s", "nothing"]) == 1
    links = lookup.backlinks(store.table("overlay_entries"), store.table("records")).collect()
    assert [(r["comp_id"], r["carried_as"]) for r in links] == [(donor.comp_id, key)]
    assert store.record_info(donor.record_id).columns[:2] == ["comp_id", "record_id"] and [r["message"] for r in store.traces(donor.record_id).collect()] == ["working"]
    assert main(["gc", f"file://{tmp_path}/s", "--before", "2000-01-01 00:00:00"]) == 0


def test_the_command_line_recalls_forces_and_removes(spark, tmp_path, capsys):
    script, root, log = tmp_path / "task.py", f"file://{tmp_path}/store", tmp_path / "log"
    script.write_text(f"from traceloom.plans.steps import step, trace\n@step(memo=True)\ndef part(i):\n    open({str(log)!r}, 'a').write('x')\n    trace('deep')\n    return i\n@step(memo=True)\ndef main():\n    return sum(h.result() for h in [part(1), part(2)])\n")
    for ran in (2, 2):
        assert main(["run", str(script), "--store", root]) == 0 and capsys.readouterr().out.strip() == "3" and log.read_text() == "x" * ran
    assert main(["show", "--store", root]) == 0
    shown = capsys.readouterr().out
    assert "cached" in shown and shown.count("deep") == 2  # the newest run told the recalled tree
    assert main(["run", str(script), "--store", root, "--force"]) == 0 and log.read_text() == "xxxx"
    store = RecordStore(spark, root)
    assert store.table("runs").count() == 1 and store.table("records").count() == 3
    run = store.newest_run()
    assert main(["show", "--store", root, "--run", run]) == 0 and main(["remove", root, run]) == 0 and main(["remove", root, run]) == 1
    capsys.readouterr()
    with pytest.raises(SystemExit):
        main(["show", "--store", root])


def test_records_are_read_when_asked_for(spark, tmp_path):
    store = RecordStore(spark, f"file://{tmp_path}/s")
    CALLS.clear()
    CALLS.append(2)
    run_and_publish(store, Engine(), whole(3), "entry")
    assert run_and_publish(store, Engine(), part(7), "other")["i"] == 7
    lazy = StoreRecords(store)
    engine = Engine(records=lazy)
    assert run_and_publish(store, engine, whole(3), "entry") == [{"i": i, "t": (i, None)} for i in range(3)] and sorted(CALLS) == [0, 1, 2, 2, 7]
    assert len(lazy.by_id) == 4  # not the other entry's
    assert lazy.get("nothing") is None and [r.identity for r in part.history(engine, 7)] == [part.identity]


def test_run_and_show_from_the_command_line(spark, tmp_path, capsys):
    script = tmp_path / "job.py"
    script.write_text("from traceloom.plans.steps import step, trace\n@step\ndef main():\n    trace('hello', state='running')\n    return 7\n")
    at = tmp_path / "runs" / "job-2024-01-01T00:00:00" / "trace.jsonl"
    assert main(["run", str(script), "--trace", str(at)]) == 0 and "7" in capsys.readouterr().out
    assert main(["show", f"file://{at}"]) == 0
    shown = capsys.readouterr().out
    assert "main" in shown and "hello [running]" in shown
    with pytest.raises(SystemExit):
        main(["run", str(script), "nothing"])

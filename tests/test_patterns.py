"""Ways to run steps, people's answers, and streams of tool calls."""

import json
import sys
import threading
import time
import warnings

import pytest
from pyspark.sql import functions as F

from traceloom.functions.codecs import Codecs, FunctionCodec, result_column, result_field
from traceloom.operators.calls import UNPARSED, assembled_calls, structured_answers, tool_events, validated_answer
from traceloom.plans.patterns import Lanes, ScriptedAnswers, TableAnswers, ask_choice, ask_confirm, ask_input, json_streams, question, refined, replayable, set_answers
from traceloom.plans.steps import lenient_trace, previous, step, trace
from traceloom.plans.testing import Harness


@pytest.fixture
def answers():
    source = ScriptedAnswers()
    set_answers(source)
    yield source
    set_answers(None)


def test_lanes_are_given_out_in_the_order_of_asking():
    lanes, order = Lanes(1), []
    lanes.__enter__()

    def work(i):
        with lanes:
            order.append(i)

    threads = []
    for i in range(8):
        threads.append(threading.Thread(target=work, args=(i,)))
        threads[-1].start()
        while len(lanes.line) < i + 1:
            time.sleep(0.001)
    lanes.__exit__()
    for t in threads:
        t.join()
    assert order == list(range(8)) and lanes.free == 1


def test_replay_keeps_the_pace_and_takes_what_fits_of_old_traces():
    def body():
        trace("a")
        time.sleep(0.1)
        trace("b", cost={"usd": 1.0}, other=3)
        return 1

    h, f = Harness(), replayable(body)
    h.run(f())
    f.history(h.engine)[0].traces[1]["progress"] = "no progress"
    began = time.monotonic()
    _, seen = h.run(f())
    assert 0.09 < time.monotonic() - began < 1.0
    a, b = seen.events("trace")
    assert b["ts"] - a["ts"] > 0.08 and b["cost"] == {"usd": 1.0} and b["other"] == 3 and "progress" not in b
    assert lenient_trace({"cost": {"n": "2"}, "progress": ["1", 4.0], "level": None, "x": 1}) == {"cost": {"n": 2.0}, "progress": [1, 4], "x": 1}


def test_a_question_offers_its_last_answer_and_can_be_pinned(answers):
    offered = []
    ask = answers.ask
    answers.ask = lambda kind, prompt, choices, default=None: offered.append(default) or ask(kind, prompt, choices, default)

    @step
    def review():
        return [ask_input("name?", default="nobody"), ask_choice("which?", ["a", "b"]), ask_confirm("sure?")]

    h = Harness()
    for a in ("Ann", "b", True):
        answers.push(a)
    value, seen = h.run(review())
    assert value == ["Ann", "b", True] and offered == ["nobody", None, None]
    assert [e["state"] for e in seen.events("trace")] == ["awaiting"] * 3
    anchor = seen.span("review")["seq"]
    assert all(e["parent_seq"] == anchor for e in seen.events("spawn") if e["name"] == "question")
    for a in ("Bo", "a", False):
        answers.push(a)
    assert h.run(review())[0] == ["Bo", "a", False] and offered[3:] == ["Ann", "b", True]
    donor = next(r for r in h.engine.records.by_id.values() if r.payload == json.dumps({"result": "Ann"}))
    key = question.comp_id(h.engine, "input", "name?", None, "nobody")
    for a in ("b", True):
        answers.push(a)
    assert h.run(review(), overlay={key: donor.record_id})[0] == ["Ann", "b", True]


def test_answers_come_from_other_threads_and_out_of_tables(spark, answers):
    answers.wait = 5.0
    threading.Timer(0.05, answers.push, ["late"]).start()
    assert ask_input("?") == "late"
    table = TableAnswers(spark.createDataFrame([("input", "a?", "x"), ("confirm", "b?", "Yes")], "kind string, prompt string, answer string"))
    set_answers(table)
    assert ask_input("a?") == "x" and ask_confirm("b?") is True
    for _ in range(2):
        with pytest.raises(LookupError, match="not answered yet"):
            ask_choice("c?", ["u", "v"], default="v")
    assert [tuple(r) for r in table.pending(spark).collect()] == [("choice", "c?", ["u", "v"], "v")]


def test_human_iteration_uses_the_earlier_answer():
    asked = []

    @step
    def review(report):
        asked.append(report)
        found, before = previous(dict)
        if found:
            return before
        return {"ok": len(asked) > 1, "spec": "more"}

    @step
    def iterate(spec):
        for _ in range(5):
            got = review(f"report per {spec}").result()
            if got["ok"]:
                return f"report per {spec}"
            spec = got["spec"]

    h = Harness()
    assert h.run(iterate("basic"))[0] == "report per more"
    assert h.run(iterate("basic"))[0] == "report per more" and len(asked) == 4


def test_an_earlier_value_of_another_class_is_none():
    @step(identity="typed")
    def f(x):
        return [previous(str)[0], previous(list)[0], x]

    h = Harness()
    assert h.run(f(1))[0] == [False, False, 1] and h.run(f(1))[0] == [False, True, 1]


def test_a_call_that_is_never_run_warns_unless_dropped():
    @step
    def f():
        return 1

    with pytest.warns(RuntimeWarning, match="never run"):
        f()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        h = f()
        h.drop()
        del h


def test_sizes_count_a_stored_value_once_and_lost_children_end_too():
    @step(memo=True)
    def child(i):
        trace("inside")
        return "same value"

    @step(memo=True)
    def parent():
        trace("before")
        child(1).result()
        trace("between")
        child(2).result()
        trace("after")
        return 0

    h = Harness()
    _, seen = h.run(parent())
    ends = [e for e in seen.events("end") if e["size"] > 20]
    assert sorted(e["own_size"] for e in ends) == [0, ends[0]["size"]]
    _, seen = h.run(parent())
    assert [e.get("msg") or e["e"] for e in seen.all if e["e"] in ("spawn", "trace", "end")] == ["spawn", "before", "spawn", "inside", "end", "between", "spawn", "inside", "end", "after", "end"]
    record = parent.history(h.engine)[0]
    h.engine.records.by_id.pop(record.children[0][1])
    from traceloom.sources.traces import MemorySink

    sink = MemorySink()
    with pytest.raises(LookupError):
        h.engine.run(parent(), overlay={record.comp_id: "none"}, sink=sink)
    h.engine.run(parent(), overlay={record.comp_id: record.record_id}, sink=sink)  # a pin asks for no children
    told = [e for e in sink.events if e["e"] in ("spawn", "end") and e.get("parent_seq") != 0]
    assert sum(e["e"] == "spawn" for e in told) == sum(e["e"] == "end" for e in told) + 1  # the run that failed


class Money:
    def __init__(self, n):
        self.n = n

    def __eq__(self, other):
        return type(self) is type(other) and self.n == other.n


class Coins(Money):
    pass


def test_payloads_are_plain_json_with_their_kinds_beside(spark):
    c = Codecs()
    c.register(Money, FunctionCodec(lambda m: (m.n, "eur"), lambda t: Money(t[0])))
    value = {"t": ((1, (2,)), [b"\x00"]), "m": [Money(3), Coins(4)], "plain": {"x": 1.5, "y": None}}
    text, _ = c.payload(value)
    assert c.load(text) == {**value, "m": [Money(3), Money(4)]} and value["t"] == ((1, (2,)), [b"\x00"])
    assert json.loads(text)["result"]["m"] == [[3, "eur"], [4, "eur"]] and "kinds" not in json.loads(c.payload([1, {"a": 2}])[0])
    row = spark.createDataFrame([(text,)], "p string").select(result_column(F.col("p"), "struct<plain:struct<x:double>>").alias("r"), result_field(F.col("p"), "m[1][0]").alias("f")).first()
    assert row["r"]["plain"]["x"] == 1.5 and row["f"] == "4"


def event(**inner):
    return {"type": "stream_event", "event": inner}


STREAM = [
    {"type": "system"}, event(type="content_block_start", index=0, content_block={"type": "text"}), event(type="content_block_delta", index=0, delta={"type": "text_delta", "text": "hi"}), event(type="content_block_stop", index=0),
    event(type="content_block_start", index=0, content_block={"type": "tool_use", "name": "read", "id": "1"}), event(type="content_block_start", index=1, content_block={"type": "tool_use", "name": "list", "id": "2"}),
    event(type="content_block_delta", index=0, delta={"type": "input_json_delta", "partial_json": '{"a":'}), event(type="content_block_delta", index=1, delta={"type": "input_json_delta", "partial_json": "oops"}),
    event(type="content_block_delta", index=0, delta={"type": "input_json_delta", "partial_json": "1}"}), event(type="content_block_stop", index=1), event(type="content_block_stop", index=0),
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "1", "content": "out"}, {"type": "tool_result", "tool_use_id": "2", "content": "bad", "is_error": True}, {"type": "text"}]}}, {"type": "user", "message": {"content": "words"}},
    event(type="content_block_start", index=0, content_block={"type": "tool_use", "name": "none", "id": "3"}), event(type="content_block_stop", index=0), event(type="content_block_start", index=2, content_block={"type": "tool_use", "name": "open", "id": "4"}),
    {"type": "result", "usage": {"input_tokens": 3, "cache_read_input_tokens": 7}, "total_cost_usd": 0.5, "result": "done", "structured_output": {"n": 2}},
]


def test_tool_calls_of_a_table_equal_those_of_the_stream(spark):
    rows = [(s, i, json.dumps(e)) for s in ("x", "y") for i, e in enumerate(STREAM)]
    events = spark.createDataFrame(rows, "stream string, ord bigint, raw string").repartition(4)
    got = tool_events(events).filter("stream = 'y'").orderBy("ord", "id").collect()
    want = list(assembled_calls(STREAM))
    assert [r["kind"] for r in got] == [w["kind"] for w in want] == ["call", "call", "output", "output", "call", "result"]
    for r, w in zip(got, want, strict=True):
        if w["kind"] == "call":
            assert (r["name"], r["id"], json.loads(r["args"])) == (w["name"], w["id"], w["args"])
        elif w["kind"] == "output":
            assert (r["text"], r["failed"]) == (w["text"], w["error"])
        else:
            assert r["cost"] == w["cost"] == {"tokens_in": 3, "tokens_cache_read": 7, "cost_usd": 0.5} and r["text"] == "done"
    assert want[0]["args"] == {UNPARSED: "oops"} and want[4]["args"] == {}
    assert tool_events(events.limit(0)).count() == 0
    assert {r["stream"]: r["answer"] and r["answer"]["n"] for r in structured_answers(events, "struct<n:int>").collect()} == {"x": 2, "y": 2}


def test_answers_of_a_form():
    assert validated_answer(STREAM, lambda v: v["n"]) == 2
    with pytest.raises(KeyError):
        validated_answer(STREAM, lambda v: v["missing"])
    with pytest.raises(RuntimeError, match="no structured output"):
        validated_answer([{"type": "result"}], dict)
    with pytest.raises(RuntimeError, match="broken"):
        validated_answer([{"type": "result", "is_error": True, "result": "broken"}], dict)


def test_programs_that_print_json_run_beside_their_rows(spark):
    code = "print('{\"a\": 1}'); print('no json'); print('[1]'); print('{\"a\": 2}')"
    commands = spark.createDataFrame([("p", [sys.executable, "-c", code]), ("q", [sys.executable, "-c", "pass"])], "stream string, command array<string>")
    assert sorted(map(tuple, json_streams(commands).collect())) == [("p", 0, '{"a": 1}'), ("p", 1, '{"a": 2}')]


def test_only_what_is_not_valid_yet_is_tried_again(spark):
    rows = spark.createDataFrame([(i, 0) for i in range(6)], "id int, value int")
    tried = []

    def attempt(left, i):
        tried.append(left.count())
        return left.withColumn("value", F.col("value") + 10)

    out = {r["id"]: (r["value"], r["attempts"], r["accepted"]) for r in refined(rows, attempt, F.col("value") >= F.col("id") * 10, 3).collect()}
    assert out == {0: (10, 1, True), 1: (10, 1, True), 2: (20, 2, True), 3: (30, 3, True), 4: (30, 3, False), 5: (30, 3, False)} and tried == [6, 4, 3]

"""A harness for steps in tests: an engine, a memory sink, and questions about the events."""

from __future__ import annotations

from typing import Any

from traceloom.plans.steps import Engine, Handle
from traceloom.sources.traces import MemorySink


class Inspector:
    def __init__(self, events: list[dict[str, Any]]):
        self.all = events

    def events(self, kind: str | None = None) -> list[dict[str, Any]]:
        return [e for e in self.all if kind is None or e["e"] == kind]

    def span(self, name: str) -> dict[str, Any]:
        """The first span of a name, with its end if it has one."""
        born = next(e for e in self.all if e["e"] == "spawn" and e["name"] == name)
        end = next((e for e in self.all if e["e"] in ("end", "error", "cancel") and e.get("seq") == born["seq"]), None)
        return {"seq": born["seq"], "name": name, "parent_seq": born.get("parent_seq"), "identity": born.get("identity"), "cached": bool(end and end.get("cached")), "start_ts": born["ts"], "end_ts": end["ts"] if end else None, "end": end}

    def name(self, seq: int) -> str:
        return next((e["name"] for e in self.all if e["e"] == "spawn" and e["seq"] == seq), f"task-{seq}")

    def child_events(self, seq: int, kind: str) -> list[dict[str, Any]]:
        return [e for e in self.events(kind) if e.get("seq" if kind == "wait" else "parent_seq") == seq]

    def edges(self, name: str) -> list[dict[str, Any]]:
        return [e for e in self.child_events(self.span(name)["seq"], "trace") if e.get("edge")]

    def executions(self) -> int:
        return len(self.events("start"))

    def cached(self) -> int:
        return sum(bool(e.get("cached")) for e in self.events("end"))


class Harness:
    def __init__(self, engine: Engine | None = None):
        self.engine = engine or Engine()

    def run(self, handle: Handle, **options: Any) -> tuple[Any, Inspector]:
        sink = MemorySink()
        self.last = Inspector(sink.events)
        return self.engine.run(handle, sink=sink, **options), self.last

"""Ways to run steps: in few lanes, from history at the old pace, until they are valid, with people's answers."""

from __future__ import annotations

import json
import queue
import subprocess
import threading
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.operators.calls import assembled_calls, validated_answer  # noqa: F401  part of this module's surface
from traceloom.plans.steps import Step, current_span, in_run, previous, step, trace
from traceloom.shared import Tables


class Lanes:
    """Places for so many bodies at a time, given out in the order of asking; a step that has lanes enters them around its body."""

    def __init__(self, places: int):
        self.free, self.line, self.lock = places, deque(), threading.Lock()

    def __enter__(self) -> None:
        trace("queued for a lane", state="pending")
        with self.lock:
            turn = None if self.free else threading.Event()
            if turn is None:
                self.free -= 1
            else:
                self.line.append(turn)
        if turn is not None:
            turn.wait()
        trace("entered a lane", state="running")

    def __exit__(self, *_: object) -> None:
        with self.lock:
            if self.line:
                self.line.popleft().set()  # the place goes on to the next, and is never free between
            else:
                self.free += 1


def rate_limited(n: int, **options: Any) -> Callable[[Callable], Step]:
    """At most n bodies at once over all calls; the others show as pending."""
    return partial(step, lanes=Lanes(n), **options)


def replayable(fn: Callable, speed: float = 1.0) -> Step:
    """A step that plays its newest record again, traces at their old pace, and runs its body only without one."""
    return step(fn, memo=False, replay_speed=speed)


def until_valid(attempt: Callable[[int], Any], valid: Callable[[Any], bool], most: int = 3) -> Any:
    """attempt(i) until its value is valid, at most so often."""
    for i in range(most):
        value = attempt(i)
        if valid(value):
            return value
    raise ValueError(f"no valid value in {most} attempts")


def refined(rows: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], valid: Column, most: int = 3) -> DataFrame:
    """The rows of attempt(rows, i), each of the first attempt after which it is valid or else of the last, with `attempts` and `accepted`.

    attempt gives its rows back with the columns that `valid` reads; only what is not valid yet is tried again.
    """
    tables, done, left = Tables(rows.sparkSession, "refined"), [], rows
    like = rows
    for i in range(most):
        tried = attempt(left, i).withColumn("accepted", F.coalesce(valid, F.lit(False))).withColumn("attempts", F.lit(i + 1))
        like = tables.save(tried)
        done.append(like.filter("accepted") if i + 1 < most else like)
        left = like.filter("not accepted").drop("accepted", "attempts")
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class Answers(Protocol):
    """Where people's answers come from. `default` is what was answered to the same question before, or what the asker offers."""

    def ask(self, kind: str, prompt: str, choices: list[str] | None, default: Any = None) -> Any: ...


class ScriptedAnswers:
    """Answers in order, whatever the kind of question; any thread may add some, and with `wait` a question waits so many seconds for one."""

    def __init__(self, answers: Iterable[Any] = (), wait: float = 0.0):
        self.queue: queue.Queue = queue.Queue()
        self.wait = wait
        for a in answers:
            self.push(a)

    def push(self, answer: Any) -> None:
        self.queue.put(answer)

    def ask(self, kind: str, prompt: str, choices: list[str] | None, default: Any = None) -> Any:
        try:
            return self.queue.get(timeout=self.wait) if self.wait else self.queue.get_nowait()
        except queue.Empty:
            raise LookupError(f"no answer left for {prompt!r}") from None


class StdinAnswers:
    """Asks on the terminal; an empty line takes the default."""

    def ask(self, kind: str, prompt: str, choices: list[str] | None, default: Any = None) -> Any:
        offered = f" [{'/'.join(choices)}]" if choices else ""
        text = input(f"{prompt}{offered}{'' if default is None else f' ({default})'} ").strip()
        if not text and default is not None:
            return default
        return text.lower() in ("y", "yes") if kind == "confirm" else text


class TableAnswers:
    """Answers out of a table(kind, prompt, answer); questions that it does not answer are noted as pending and end their step."""

    def __init__(self, answers: DataFrame):
        self.answers, self.open = answers, []

    def ask(self, kind: str, prompt: str, choices: list[str] | None, default: Any = None) -> Any:
        row = self.answers.filter((F.col("kind") == kind) & (F.col("prompt") == prompt)).select("answer").first()
        if row is None:
            self.open.append((kind, prompt, choices, None if default is None else str(default)))
            raise LookupError(f"{prompt!r} is not answered yet")
        return row["answer"].lower() in ("true", "y", "yes") if kind == "confirm" else row["answer"]

    def pending(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.open, "kind string, prompt string, choices array<string>, default string").distinct()


_answers: list[Answers] = []


def set_answers(source: Answers | None) -> None:
    _answers[:] = [source] if source is not None else []


@step(identity="traceloom.question")
def question(kind: str, prompt: str, choices: list[str] | None, default: Any) -> Any:
    """A question as a step: pinned by an overlay like any other, and offering what it was answered before."""
    if not _answers:
        raise RuntimeError("nobody is there to answer")
    if current_span() is not None:
        trace(prompt, state="awaiting")
    found, before = previous()
    return _answers[0].ask(kind, prompt, choices, default=before if found else default)


def _ask(kind: str, prompt: str, choices: list[str] | None, default: Any) -> Any:
    """As a child of the step that asks; outside of a run at once."""
    asked = (kind, prompt, choices, default)
    return question(*asked).result() if in_run() else question.fn(*asked)


def ask_input(prompt: str, default: str | None = None) -> str:
    return _ask("input", prompt, None, default)


def ask_choice(prompt: str, choices: list[str], default: str | None = None) -> str:
    answer = _ask("choice", prompt, list(choices), default)
    if answer not in choices:
        raise ValueError(f"{answer!r} is none of {choices}")
    return answer


def ask_confirm(prompt: str, default: bool | None = None) -> bool:
    return bool(_ask("confirm", prompt, None, default))


def json_lines(command: list[str], most: int = 64 << 20) -> Iterator[dict[str, Any]]:
    """JSON objects that a program prints, one a line; a longer line than `most` bytes ends it with an error."""
    with subprocess.Popen(command, stdout=subprocess.PIPE) as run:
        while line := run.stdout.readline(most + 1):
            if len(line) > most:
                run.kill()
                raise ValueError("a line is too long")
            try:
                value = json.loads(line)
            except ValueError:
                continue
            if isinstance(value, dict):
                yield value
    if run.returncode:
        raise RuntimeError(f"{command[0]} ended with {run.returncode}")


def json_streams(commands: DataFrame, most: int = 64 << 20) -> DataFrame:
    """stream, ord, raw: the JSON lines that the commands(stream, command array) print, run where their rows lie."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for stream, command in zip(pdf["stream"], pdf["command"], strict=True):
                lines = [(stream, i, json.dumps(v)) for i, v in enumerate(json_lines(list(command), most))]
                yield pd.DataFrame(lines, columns=["stream", "ord", "raw"])

    return commands.select("stream", "command").mapInPandas(run, "stream string, ord long, raw string")

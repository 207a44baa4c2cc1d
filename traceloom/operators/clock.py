"""How long recalled work would have taken: a clock that cache hits put forward and awaits take over.

A span starts at its parent's clock; recalling puts its own clock forward by the record's durations; a parent that
resumes takes the later of its clock and the awaited span's. So awaited in turn times add up, and together the
longest counts. It depends on the order of events, hence an ordered fold over each run; a run's events stream through
one task, which holds a number a span of the run, and runs are folded side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("run_id", "e", "seq", "parent_seq", "on_seq", "cached", "took")


class Clocks:
    """The clocks of one run's spans."""

    def __init__(self, run_id: str):
        self.run_id, self.now, self.began = run_id, {}, {}

    def take(self, e: str, seq: int, parent: int, on: int, cached: bool, took: float) -> None:
        """Numbers are -1 where an event has none."""
        if e == "spawn":
            self.began[seq] = self.now[seq] = self.now.get(parent, 0.0)
        elif seq in self.now and e == "end" and cached:
            self.now[seq] = self.began[seq] + took
        elif seq in self.now and e == "resume" and on in self.now:
            self.now[seq] = max(self.now[seq], self.now[on])

    def rows(self) -> list[tuple]:
        return [(self.run_id, s, max(0.0, at - self.began[s])) for s, at in self.now.items()]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    run: Clocks | None = None
    for pdf in batches:
        done: list[tuple] = []
        for run_id, *event in pdf[list(COLUMNS)].itertuples(index=False, name=None):
            if run is None or run.run_id != run_id:
                done += run.rows() if run is not None else []
                run = Clocks(run_id)
            run.take(*event)
        if done:
            yield pd.DataFrame(done, columns=["run_id", "seq", "cached_duration"])
    if run is not None:
        yield pd.DataFrame(run.rows(), columns=["run_id", "seq", "cached_duration"])


def cached_durations(events: DataFrame) -> DataFrame:
    """run_id, seq, cached_duration of each span, from events with on_seq on resumes."""
    number = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c)
    took = F.coalesce("duration", F.lit(0.0)) + F.coalesce("cached_duration", F.lit(0.0))
    kept = events.filter(F.col("e").isin("spawn", "end", "resume") & F.col("seq").isNotNull())
    kept = kept.select(F.coalesce("run_id", F.lit("")).alias("run_id"), "ord", "e", number("seq"), number("parent_seq"), number("on_seq"), F.coalesce("cached", F.lit(False)).alias("cached"), took.cast("double").alias("took"))
    ordered = kept.repartition("run_id").sortWithinPartitions("run_id", "ord")
    return ordered.select(*COLUMNS).mapInPandas(_fold, "run_id string, seq int, cached_duration double")

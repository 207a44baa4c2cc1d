"""Questions about a run's events and a store's runs, as tables: spans by name, children, counts, timelines, what is next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_named(events: DataFrame, name: str | None = None) -> DataFrame:
    """run_id, name, seq, parent_seq, identity, start_ts, end_ts, cached: the first span of each name, or of one, with its end if it has one."""
    spawns = events.filter("e = 'spawn'") if name is None else events.filter((F.col("e") == "spawn") & (F.col("name") == name))
    first = spawns.groupBy("run_id", "name").agg(F.min_by(F.struct("seq", "parent_seq", "identity", "ts"), "ord").alias("_s"))
    ends = events.filter(F.col("e").isin("end", "error", "cancel")).groupBy("run_id", "seq").agg(F.min_by(F.struct("ts", "cached"), "ord").alias("_e"))
    rows = first.select("run_id", "name", F.col("_s.seq").alias("seq"), F.col("_s.parent_seq").alias("parent_seq"), F.col("_s.identity").alias("identity"), F.col("_s.ts").alias("start_ts"))
    return rows.join(ends, ["run_id", "seq"], "left").select("run_id", "name", "seq", "parent_seq", "identity", "start_ts", F.col("_e.ts").alias("end_ts"), F.coalesce("_e.cached", F.lit(False)).alias("cached"))


def child_events(events: DataFrame, seq: int | Column, kind: str) -> DataFrame:
    """Events of a kind below a span: a wait's span is its own, other events name their parent."""
    return events.filter((F.col("e") == kind) & (F.col("seq" if kind == "wait" else "parent_seq") == seq))


def edge_notes(events: DataFrame, name: str) -> DataFrame:
    """Traces marked as edges below the first span of a name."""
    owner = first_named(events, name).select("run_id", F.col("seq").alias("parent_seq"))
    return events.filter("e = 'trace' and edge").join(owner, ["run_id", "parent_seq"], "left_semi")


def children(spans: DataFrame, seq: int) -> DataFrame:
    return spans.filter(F.col("parent_seq") == seq)


def counts(events: DataFrame, *key: str) -> DataFrame:
    """key, e, n, cached, first_ord: events by kind, how many of them cached, and the first."""
    return events.groupBy(*key, "e").agg(F.count(F.lit(1)).alias("n"), F.count_if("cached").alias("cached"), F.min("ord").alias("first_ord"))


def executions(events: DataFrame) -> DataFrame:
    """run_id, executions, recalled: bodies that ran, and ends that were recalled."""
    return events.groupBy("run_id").agg(F.count_if(F.col("e") == "start").alias("executions"), F.count_if((F.col("e") == "end") & F.col("cached")).alias("recalled"))


def fan_out(events: DataFrame) -> DataFrame:
    """run_id, seq, spawned: how many children each span starts before its first wait; several mean that they may overlap."""
    first = events.filter("e = 'wait'").groupBy("run_id", "seq").agg(F.min("ord").alias("_wait"))
    born = events.filter("e = 'spawn' and parent_seq is not null").select("run_id", F.col("parent_seq").alias("seq"), "ord")
    return born.join(first, ["run_id", "seq"], "left").groupBy("run_id", "seq").agg(F.count_if(F.col("_wait").isNull() | (F.col("ord") < F.col("_wait"))).alias("spawned"))


def first_time(events: DataFrame, *key: str) -> DataFrame:
    """key, began: the time of the first event that has one other than zero."""
    return events.groupBy(*key).agg(F.min_by("ts", F.when(F.col("ts") != 0, F.col("ord"))).alias("began"))


def timeline(*streams: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows of several streams(key, at, ...) as one, with their `place` in time; at equal times in the streams' order, then by `nth`."""
    both = streams[0].withColumn("_stream", F.lit(0))
    for i, more in enumerate(streams[1:], 1):
        both = both.unionByName(more.withColumn("_stream", F.lit(i)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("at", "_stream", "ref", "nth")
    return both.withColumn("place", F.row_number().over(order).cast("bigint")).drop("_stream")


def runs_per_entry(runs: DataFrame) -> DataFrame:
    return runs.groupBy("entry").agg(F.count(F.lit(1)).alias("runs"), F.min("run_id").alias("first_run"))


def selector(runs: DataFrame) -> DataFrame:
    """runs with the place of each in a list of entries by name, each entry's newest run first."""
    return runs.withColumn("nth", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("started_at"), F.desc("run_id"))).cast("bigint"))


def next_flagged(ordered: DataFrame, key: str, place: str, flagged: Column) -> DataFrame:
    """key, place and the flagged place after it, going round: from the last one on it is the first again; null where none is flagged."""
    marks = F.when(flagged, F.col(place))
    after = F.min(marks).over(Window.partitionBy(key).orderBy(place).rowsBetween(1, Window.unboundedFollowing))
    first = F.min(marks).over(Window.partitionBy(key))
    return ordered.select(key, place, F.coalesce(after, first).alias("next"))


def evaluation(scores: DataFrame, key: list[str], score: Column, won: Column) -> DataFrame:
    """key, mean, win_rate, n of scores; a null score counts neither way."""
    held = scores.filter(score.isNotNull())
    return held.groupBy(*key).agg(F.avg(score).alias("mean"), (F.count_if(won) / F.count(F.lit(1))).alias("win_rate"), F.count(F.lit(1)).alias("n"))


def generic_fields(raw: Column, known: tuple[str, ...]) -> Column:
    """An event's fields that are none of the known ones, as a map of texts; null if there is none."""
    fields = F.from_json(raw, "map<string,string>")
    others = F.map_filter(fields, lambda k, v: ~k.isin(*known) & v.isNotNull())
    return F.when(F.size(others) > 0, others)

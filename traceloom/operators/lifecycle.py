"""Runs, retention and garbage collection by reachability."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.shared import Tables


def runs_listed(runs: DataFrame, run_steps: DataFrame) -> DataFrame:
    """runs with their number of steps and whether each is its entry's newest (and newest that ended well)."""
    steps = run_steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"))
    newest = runs.groupBy("entry").agg(
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("_new"),
        F.max_by("run_id", F.when(F.col("status") == "ok", F.struct("started_at", "run_id"))).alias("_ok"),
    )
    out = runs.join(newest, "entry").join(steps, "run_id", "left").withColumn("steps", F.coalesce("steps", F.lit(0)))
    return out.withColumn("is_latest", F.col("run_id") == F.col("_new")).withColumn("is_latest_ok", F.coalesce(F.col("run_id") == F.col("_ok"), F.lit(False))).drop("_new", "_ok")


def expired(listed: DataFrame, before: datetime | str, keep_latest: bool = True) -> DataFrame:
    """Runs that started before a time, without those that are their entry's newest."""
    old = listed.filter(F.col("started_at") < F.lit(before))
    return old.filter(~F.col("is_latest")) if keep_latest else old


def step_ordinals(events: DataFrame) -> DataFrame:
    """Steps of runs from their end events that have a record, numbered in order; names come from the spawns."""
    names = events.filter("e = 'spawn'").groupBy("run_id", "seq").agg(F.max_by("name", "ord").alias("name"))
    ends = events.filter("e = 'end' and record_path is not null").drop("name").join(names, ["run_id", "seq"], "left")
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("ord"))
    return ends.select("run_id", nth.alias("ordinal"), F.coalesce("name", F.concat(F.lit("task-"), F.col("seq").cast("string"))).alias("name"), "record_path", "origin")


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node: all that can be reached from roots(node) over edges(src, dst).

    The edges are worked out once; a round reads them, and writes only the nodes that are new.
    """
    ways, tables = Tables(roots.sparkSession, "reach-edges"), Tables(roots.sparkSession, "reach")
    edges = ways.save(edges.select("src", "dst").filter("dst is not null"))
    seen = frontier = tables.save(roots.select("node").distinct())
    while not frontier.isEmpty():
        step = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = tables.save(step.join(seen, "node", "left_anti"))
        seen = tables.together(frontier, tables.written)
    ways.drop_all_but()
    return seen


def live_records(runs: DataFrame, run_steps: DataFrame, children: DataFrame) -> DataFrame:
    """record_id of all that the runs' steps reach."""
    roots = run_steps.join(runs.select("run_id"), "run_id", "left_semi").select(F.col("record_id").alias("node"))
    edges = children.select(F.col("record_id").alias("src"), F.col("child_record_id").alias("dst"))
    return reachable(roots.filter("node is not null"), edges).select(F.col("node").alias("record_id"))


def sweep(records: DataFrame, blobs: DataFrame, live: DataFrame) -> dict[str, DataFrame]:
    """What stays and what goes: records, blobs, removed_records, removed_blobs."""
    kept = records.join(live, "record_id", "left_semi")
    held = kept.select(F.col("result_hash").alias("content_hash")).distinct()
    return {
        "records": kept,
        "blobs": blobs.join(held, "content_hash", "left_semi"),
        "removed_records": records.join(live, "record_id", "left_anti"),
        "removed_blobs": blobs.join(held, "content_hash", "left_anti"),
    }

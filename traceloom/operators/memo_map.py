"""Mapping a function over a table, computing only what no record holds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.operators.lookup import newest
from traceloom.shared import materialise


def new_record_ids(n: int) -> list[str]:
    """Ids that sort by time of making, to the millisecond."""
    return [str(uuid.uuid7() if hasattr(uuid, "uuid7") else _uuid7()) for _ in range(n)]


def _uuid7() -> uuid.UUID:
    import os
    import time

    stamp = time.time_ns() // 1_000_000
    rand = int.from_bytes(os.urandom(10), "big")
    value = stamp << 80 | 0x7 << 76 | (rand >> 68 & 0xFFF) << 64 | 0x2 << 62 | rand & (1 << 62) - 1
    return uuid.UUID(int=value)


def memo_map(args: DataFrame, comp_id: Column, records: DataFrame, body: Callable[[dict[str, Any]], str] | Column, overlay: DataFrame | None = None, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(args with comp_id, result, error and origin; the new records(comp_id, record_id, result, error)).

    records(comp_id, record_id, result, error, ts_created, ...): a hit is the newest without error that fits `where`;
    overlay(comp_id, result) goes before hits. Equal computations of one call run once. A row whose body raises gets
    its error, and the others go on; errors are never hits. New records are written before they are read twice. A body
    that is a column of args stays in the JVM; its row's failure is the query's.
    """
    keyed = args.withColumn("comp_id", comp_id)
    sound = F.col("error").isNull() if where is None else F.col("error").isNull() & where
    known = newest(records, ["comp_id"], where=sound).select("comp_id", F.lit(1).alias("_rank"), F.col("result").alias("_known"))
    if overlay is not None:
        pins = overlay.select("comp_id", F.lit(0).alias("_rank"), F.col("result").alias("_known"))
        known = known.unionByName(pins).groupBy("comp_id").agg(F.min_by(F.struct("_rank", "_known"), "_rank").alias("_k")).select("comp_id", "_k.*")
    misses = keyed.join(known, "comp_id", "left_anti").dropDuplicates(["comp_id"])
    names = args.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for comp, *values in pdf[["comp_id", *names]].itertuples(index=False):
                try:
                    out.append((comp, body(dict(zip(names, values, strict=True))), None))
                except Exception as e:  # noqa: BLE001  a row's failure is a row
                    out.append((comp, None, f"{type(e).__name__}: {e}"))
            new = pd.DataFrame(out, columns=["comp_id", "result", "error"])
            yield new.assign(record_id=new_record_ids(len(new)))

    if isinstance(body, Column):
        new = misses.select("comp_id", body.cast("string").alias("result"), F.lit(None).cast("string").alias("error"), F.expr("uuid()").alias("record_id"))
    else:
        new = misses.mapInPandas(run, "comp_id string, result string, error string, record_id string")
    fresh = materialise(new, "memo")
    made = fresh.select("comp_id", F.lit(2).alias("_rank"), F.col("result").alias("_known"), F.col("error").alias("_error"))
    rows = keyed.join(known.withColumn("_error", F.lit(None).cast("string")).unionByName(made), "comp_id", "left")
    origin = F.when(F.col("_rank") == 0, "carried").when(F.col("_rank") == 1, "recalled").otherwise("created")
    out = rows.withColumn("result", F.col("_known")).withColumn("error", F.col("_error")).withColumn("origin", origin)
    return out.drop("_rank", "_known", "_error"), fresh

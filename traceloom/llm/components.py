"""Connected components of a table of links, by minimum labels and pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import Scratch


def keyed_join(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """left with right's columns, by `column`; right has a row a key.

    The join is on a column more than right is grouped by, so that Spark deals both sides anew and can split a hot key.
    """
    right = right.withColumnRenamed(column, "_jk").withColumn("_jh", F.xxhash64("_jk"))
    return left.withColumn("_lh", F.xxhash64(column)).join(right, (F.col(column) == F.col("_jk")) & (F.col("_lh") == F.col("_jh")), how).drop("_jk", "_jh", "_lh")


def connected(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp for each node of links(a, b); comp is the least node that can be reached."""
    # With each node its own neighbour, a round's least neighbour is never worse than the node's own label.
    pairs = links.select("a", "b").union(links.select("b", "a"))
    both = scratch.save(pairs.union(pairs.select("a", F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        own = F.when(F.col("a") == F.col("node"), F.col("comp"))
        reach = keyed_join(both.withColumnRenamed("b", "node"), labels, "node").groupBy("a").agg(F.max(own).alias("old"), F.min("comp").alias("node"))
        # A label is itself a node with a label, which is at least as good.
        jumped = keyed_join(reach, labels, "node").select(F.col("a").alias("node"), "old", "comp")
        done = scratch.save(jumped, f"{name}-{step}")
        labels = done.select("node", "comp")
        if step > 1:
            scratch.drop(f"{name}-{step - 1}")
        if done.filter("old <> comp").isEmpty():
            scratch.drop(f"{name}-links")
            return labels

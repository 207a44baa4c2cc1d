"""Shared plumbing: tables in the cluster's shared folder, ordered ranges, column names that do not clash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.shared import delete_path, shared_root


class Scratch:
    """Written tables that cut lineage: they outlive lost executors and are read back by Spark."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/traceloom-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
        df.write.option("compression", codec).parquet(f"{self.path}/{label}")
        return self.read(label, df)

    def read(self, label: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{label}")

    def drop(self, label: str = "") -> None:
        delete_path(self.spark, f"{self.path}/{label}" if label else self.path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it; Spark does not tell case apart."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def range_bounds(keys: DataFrame, column: str, parts: int) -> tuple[list, list]:
    """(least key, greatest key) of each of at most `parts` ranges of the keys, in order; nulls aside.

    Only the key column is moved, and one row a range comes to the driver.
    """
    ranges = keys.select(F.col(column).alias("k")).filter("k is not null").repartitionByRange(parts, "k")
    ends = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect()
    ends.sort(key=lambda r: r["lo"])
    return [r["lo"] for r in ends], [r["hi"] for r in ends]

"""Tables written to the folder that the cluster's machines share; they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and all of Spark is one local process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="traceloom-")
    return _LOCAL[app]


class Tables:
    """Written tables of one operator: a name written again is a new folder, and what nothing reads any more can go."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.count = spark, f"{shared_root(spark)}/traceloom-{name}-{uuid.uuid4().hex}", 0
        self.written: list[str] = []

    def save(self, df: DataFrame) -> DataFrame:
        """df, written once and read back."""
        self.count += 1
        self.written.append(f"{self.path}/{self.count}")
        df.write.parquet(self.written[-1])
        return self.read(df, self.written[-1])

    def read(self, like: DataFrame, *paths: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*paths)

    def together(self, like: DataFrame, paths: list[str]) -> DataFrame:
        """Several written tables of one form as one scan, however many they are."""
        return self.read(like, *paths)

    def drop(self, *paths: str) -> None:
        for path in paths:
            delete_path(self.spark, path)
            self.written.remove(path)

    def drop_all_but(self, *paths: str) -> None:
        self.drop(*[p for p in self.written if p not in paths])


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """df, written once and read back; it stays for as long as the shared folder does."""
    return Tables(df.sparkSession, label).save(df)


def delete_path(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: every executor can
read it, a lost executor loses nothing, and a table is deleted as soon as the next
step has been written. An operator leaves the one table that its result reads;
``clear`` deletes what the operators of this process have left.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named, a local session gets one of its own, a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` such that its next join is a sort-merge join.

    Spark plans a broadcast by the size of the files, and takes a row's explosion for one
    row: a few MB of packed labels, or of places repeated into nine cells, become hundreds of
    MB of rows in the driver.
    """
    return df.hint("merge")


def clear(spark: SparkSession) -> None:
    """Deletes the tables that results of this process still read."""
    while _LEFT:
        _delete(spark, _LEFT.pop())


class Scratch:
    """Names the intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str, parent: Scratch | None = None):
        self.spark = spark
        name = f"{label}-{uuid.uuid4().hex[:12]}"
        self.root = f"{parent.root if parent else shared_dir(spark)}/{name}"
        self.tables: set[str] = set()
        if parent:
            parent.tables.add(name)
        else:
            _LEFT.add(self.root)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.tables.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads, and the shuffle files of the plans that made them."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
            self.tables.discard(name)
        if names:
            self.free_shuffles()

    def keep(self, name: str) -> None:
        """Deletes all tables but one."""
        self.drop(*(self.tables - {name}))

    def free_shuffles(self) -> None:
        """Lets Spark delete the shuffle files of finished steps: it does so once their plans are garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

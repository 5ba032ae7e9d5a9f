"""Cutting the lineage of iterative jobs in storage that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in one process (tests) a local one is made where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Rounds:
    """Tables of an iterative job in one folder below the shared one, which goes when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, new_folder(spark, name), 0
        atexit.register(remove, spark, self.path)

    def put(self, df: DataFrame, old: DataFrame | None = None) -> DataFrame:
        """df, written and read back; then old, which nothing reads any more, is deleted. Shuffle files go with the write."""
        self.n += 1
        at, name = f"{self.path}/{self.n}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.set(name, before)
        back = self.spark.read.schema(df.schema).parquet(at)
        back.round_path = at
        if old is not None:
            remove(self.spark, old.round_path)
        return back

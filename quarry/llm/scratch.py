"""Intermediate tables in the folder that all executors share.

An operator that reads a result twice, or that wants its lineage cut, writes it as Parquet under the
folder named by ``spark.checkpoint.dir`` and reads it back, so a lost executor costs one task's work and
never the table. Only where the session names no folder and runs in one process (tests) is a local one made.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; set here only if the session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, so that long texts don't fill a Python worker.

    The setting is the session's and is read when a plan runs, so it stays set; a smaller one is left alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(ValueError):
        if int(spark.conf.get(name)) <= BATCH_BYTES:
            return
    spark.conf.set(name, str(BATCH_BYTES))


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark deletes an execution's shuffle files when it ends; for writes, whose plans never run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Spark's own file system layer."""
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """One operator call's folder below the shared one; everything in it goes when the process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(remove, spark, self.path)

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df, in folders by a column if one is named, and read it back with the same schema."""
        self.n += 1
        at = f"{self.path}/{self.n:03d}-{name}"
        with shuffles_go(self.spark):
            (df.write.partitionBy(by) if by else df.write).parquet(at)
        back = self.spark.read.schema(df.schema).parquet(at)
        back.scratch_path = at
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            remove(self.spark, t.scratch_path)

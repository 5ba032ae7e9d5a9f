"""Distributed row ranks within strata, by built-in functions only.

A window over a stratum would put a hot source into one task. Here each stratum is cut into ranges of a seeded
hash, rows are counted per range, and a row's rank is the count of the ranges before plus its place in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import Scratch

#: Rows of a stratum that one window group should hold.
RANGE_ROWS = 4096
MAX_RANGE_BITS = 20


def stratum(source: Column) -> Column:
    """A source's name in a form in which null is a stratum of its own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def shuffle_key(seed: str, row_id: Column) -> Column:
    """A seeded random order: md5 of the seed and the id, as hex."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null"))).cast("binary"))


def range_bits(rows: int, range_rows: int = RANGE_ROWS) -> int:
    """Bits of the key that name a range; at least 8, so that ranges outnumber the tasks."""
    return min(MAX_RANGE_BITS, max(8, (max(rows, 1) // range_rows).bit_length()))


def add_rank(rows: DataFrame, by: str, bucket: Column, order: list[Column], rank: str, counted: DataFrame | None = None) -> DataFrame:
    """Adds rank (from 1) and rank_total within `by`; `bucket` is an integer that never decreases along `order` within `by`.

    counted: what to count instead of rows, if it is cheaper to scan; it needs `by` and the bucket's inputs."""
    cut = rows.withColumn("bucket_", bucket)
    sizes = (rows if counted is None else counted).withColumn("bucket_", bucket).groupBy(by, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(by).alias("by_"), F.col("bucket_").alias("at_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"), F.sum("n_").over(Window.partitionBy(by)).alias(f"{rank}_total"))
    placed = cut.withColumn("place_", F.row_number().over(Window.partitionBy(by, "bucket_").orderBy(*order)))
    joined = placed.join(offsets, (placed[by] == offsets["by_"]) & (placed["bucket_"] == offsets["at_"]))
    return joined.withColumn(rank, F.col("before_") + F.col("place_")).drop("bucket_", "place_", "by_", "at_", "before_")


def add_position(rows: DataFrame, order: list[Column], position: str, scratch: Scratch) -> DataFrame:
    """Adds each row's position (from 1) in an order of all rows: ranges of the order are sorted apart, and counts put one behind the other.

    The ranges are written, so that a range keeps its rows whatever happens to its task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.put(rows.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()), position)
    sizes = ranged.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    offsets = sizes.select(F.col("range_").alias("at_"), before.alias("before_"))
    placed = ranged.withColumn("place_", F.row_number().over(Window.partitionBy("range_").orderBy(*order)))
    return placed.join(offsets, placed["range_"] == offsets["at_"]).withColumn(position, F.col("before_") + F.col("place_")).drop("range_", "place_", "at_", "before_")

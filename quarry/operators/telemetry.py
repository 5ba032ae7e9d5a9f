"""The query log and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_SCHEMA = "id LONG, logged_at TIMESTAMP, q STRING, orderby STRING, unique_by STRING, cache_hit BOOLEAN, execute_ms DOUBLE, fetch_ms DOUBLE, total_ms DOUBLE, result_count INT, total_cards LONG, had_error BOOLEAN"


def append_log(rows: DataFrame, path: str) -> None:
    """Appends rows to a log, in folders by day."""
    rows.withColumn("day", F.to_date("logged_at")).write.mode("append").partitionBy("day").parquet(path)


def statistics(log: DataFrame, by: str | None = None) -> DataFrame:
    """Counts, success rate, latencies and rows of queries, in all or by a column."""
    ok = F.col("had_error") == F.lit(False)
    return log.groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("queries"),
        (100 * F.avg(F.when(ok, 1.0).otherwise(0.0))).alias("success_pct"),
        F.avg(F.when(ok, F.col("total_ms"))).alias("avg_ms"),
        F.min(F.when(ok, F.col("total_ms"))).alias("min_ms"),
        F.max(F.when(ok, F.col("total_ms"))).alias("max_ms"),
        F.sum(F.when(ok, F.col("result_count"))).alias("rows"),
    )

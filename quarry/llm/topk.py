"""Exact top-k inner products over norm-sorted vectors with rotated partial sums.

Candidates are written in ranges of descending length over all tasks, and read by descending length within each. Both sides are
rotated by the singular vectors of a bounded sample (any rotation keeps inner products, a good one gathers them in the
first coordinates). While a task has a query's k-th score, a run of candidates is skipped if |q| |c| can't reach it; else
the partial sum over HEAD coordinates plus the Cauchy-Schwarz bound on the rest is compared, and only the survivors
get their exact integer product. Bounds carry slack for rounding and equal scores survive, so the result is exact.

Queries come in blocks of at most about BLOCK (a stated query set against all rows). A block meets the range of the longest
candidates first; the k-th scores found there are where all other tasks start from, and ranges whose longest vector can't
reach them for any query are not read at all. A block's result is written and its broadcast freed before the next one's, so
plans and memory don't grow with the number of queries. A task returns at most k rows a query, and a window keeps the best
k of those.

Defined results: vectors that are null, or hold null or non-finite components, and null ids take no part; shorter
vectors are padded with zeros; rows that share a query's id are not its candidates, repeated query rows
count once, and those that share an id but not a vector rank together; ties go to the smaller id; scores beyond a long are
held at its ends; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.scratch import Scratch, small_batches

HEAD, BLOCK, SAMPLE, RUN = 16, 4096, 8192, 1024


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and v, the components as floor(scale * x), of the vectors that take part."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, floor: np.ndarray, k: int):
        """floor: a score that each query's k-th reaches anyway."""
        n, self.k, self.floor = len(floor), k, floor.copy()
        self.score = [np.zeros(0, np.int64) for _ in range(n)]
        self.id = [np.zeros(0, np.int64) for _ in range(n)]

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate((self.score[q], score)), np.concatenate((self.id[q], ids))
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.id[q] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], self.score[q][-1])


def products(vectors: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
    """Exact inner products; where they might not fit a long, those that don't are held at its ends."""
    if safe:
        return vectors @ query
    exact = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


def scan(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """The best k of each query among candidates that come by descending length."""
    width, best = queries.shape[1], Best(floor, k)
    head = min(HEAD, width)
    rotated = queries @ turn
    q_all, q_rest = np.linalg.norm(rotated, axis=1), np.linalg.norm(rotated[:, head:], axis=1)
    for b in batches:
        own, vectors = b.column(0).to_numpy(), matrix(b.column(1), width)
        spun = vectors @ turn
        c_all, c_rest = np.linalg.norm(spun, axis=1), np.linalg.norm(spun[:, head:], axis=1)
        for at in range(0, len(own), RUN):
            part = slice(at, at + RUN)
            longest = c_all[part].max()
            slack = 1 + 1e-9 * q_all * longest
            active = np.flatnonzero(q_all * longest + slack >= best.floor)
            for some in np.array_split(active, max(1, len(active) // 64)):
                if not len(some):
                    continue
                bound = rotated[some, :head] @ spun[part, :head].T + q_rest[some, None] * c_rest[None, part] + slack[some, None]
                hit = (bound >= best.floor[some, None]) & (own[None, part] != ids[some, None])
                for q, near in zip(some, hit):
                    where = np.flatnonzero(near) + at
                    if len(where):
                        best.add(q, products(vectors[where], queries[q], q_all[q] * longest < 1 << 62), own[where])
    return best


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "topk")
    rows = scratch.put(quantised(vectors).withColumn("length", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)), "vectors")
    n, width, asked = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    width = max(1, width)
    draw = F.pmod(F.xxhash64(F.lit("rotation"), "vec_id"), F.lit(1 << 30))
    sample = rows.filter(draw < min(1 << 30, (SAMPLE << 30) // max(n, 1) + 1)).select("v").toArrow()
    seen = matrix(sample.column(0).combine_chunks(), width).astype(float) if sample.num_rows else np.zeros((1, width))
    turn = np.linalg.svd(seen.T @ seen)[0]
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.put(rows.repartitionByRange(parts, F.desc("length"), "vec_id").withColumn("range_", F.spark_partition_id()), "ranges", by="range_")
    longest = dict(sorted(ranged.groupBy("range_").agg(F.sqrt(F.max("length"))).collect()))  # one row a range
    candidates = ranged.sortWithinPartitions(F.desc("length")).select("vec_id", "v", "range_")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    blocks, found = max(1, -(-asked // BLOCK)), []
    for block in range(blocks):
        got = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        if not got.num_rows and (block or found):
            continue
        ids = got.column(0).to_numpy()
        asked_for = matrix(got.column(1).combine_chunks(), width) if got.num_rows else np.zeros((0, width), np.int64)

        def best(of: DataFrame, floor: np.ndarray, name: str, ids=ids, asked_for=asked_for) -> DataFrame:
            """The k best of each query among some ranges, written."""
            sent = spark.sparkContext.broadcast((ids, asked_for, floor))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                ids, asked_for, floor = sent.value
                best = scan(batches, ids, asked_for, turn, k, floor)
                counts = [len(x) for x in best.id]
                if sum(counts):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, counts)), pa.array(np.concatenate(best.id)), pa.array(np.concatenate(best.score))], ["query_id", "vec_id", "score"])

            tasks = of.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
            told = scratch.put(tasks.withColumn("rank", rank).filter(F.col("rank") <= k), name)
            sent.destroy()
            return told

        head, rest = next(iter(longest), 0), list(longest)[1:]
        told = best(candidates.filter(F.col("range_") == head), np.full(len(ids), -np.inf), "head")
        if rest and len(ids):
            kth = dict(told.filter(F.col("rank") == k).select("query_id", "score").collect())  # a row a query of the block
            floor = np.array([kth.get(i, -np.inf) for i in ids.tolist()], float)
            size = np.linalg.norm(asked_for.astype(float), axis=1)
            wanted = [r for r in rest if (size * longest[r] * (1 + 1e-9) + 1 >= floor).any()]
            if wanted:
                more = best(candidates.filter(F.col("range_").isin(wanted)), floor, "rest")
                told = scratch.put(told.unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= k), "block")
        found.append(told.scratch_path)
    return spark.read.schema("query_id long, vec_id long, score long, rank int").parquet(*found).select("query_id", "rank", "vec_id", "score")

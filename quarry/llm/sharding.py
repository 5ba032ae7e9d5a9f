"""Sharding by proportional stratified interleaving; its law is `rows`: counts are at most one apart.

Rows of each source are put in a seeded random order and ranked; row r of n stands at the fraction
(2r - 1) / 2n. Ordering all rows by fraction spreads every source evenly, so cutting the order into equal
runs gives shards that hold each source in its proportion of the whole, to within about one row per source.
Both rankings are distributed (see ranks.py): the one within sources by ranges of the hash, the one over all rows by ranges of
the whole order, so that equal fractions (of many sources with one row each, say) don't meet in one task. Texts are read
once, for size and checksum, and never shuffled. The law asks nothing of equal texts: they may lie in different shards.

Defined results: a null text has no bytes (size 8) and checksum 0; null sources are a stratum of their own;
repeated rows take neighbouring slots; with fewer rows than shards some shards are empty; an empty table gives
an empty result; other columns are ignored; rows without a doc_id share one place in their source's shuffled order, so a
source in which all lack it is ranked in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.ranks import add_position, add_rank, range_bits, shuffle_key, stratum
from quarry.llm.scratch import Scratch


def shards(docs: DataFrame, n_shards: int = 24, seed: str = "shard") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    scratch, rows = Scratch(docs.sparkSession, "shards"), docs.count()
    bits = range_bits(rows)
    keys = docs.select(F.col("doc_id"), F.col("source"), stratum(F.col("source")).alias("stratum"), shuffle_key(seed, F.col("doc_id")).alias("key"))
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select("doc_id", "source", stratum(F.col("source")).alias("stratum"), shuffle_key(seed, F.col("doc_id")).alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    lead = F.shiftright(F.conv(F.substring("key", 1, 5), 16, 10).cast("int"), 20 - bits)
    ranked = add_rank(measured, "stratum", lead, [F.col(c) for c in ("key", "doc_id", "text_crc32", "size")], "rank", counted=keys)
    placed = ranked.withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("rank_total")))
    lined = add_position(placed, [F.col(c) for c in ("fraction", "stratum", "key", "doc_id", "text_crc32", "size")], "pos", scratch)
    cut = lined.withColumn("shard", F.expr(f"cast((pos - 1) * {n_shards} div {max(rows, 1)} as int)"))
    slot = F.expr(f"pos - 1 - (shard * {rows}L + {n_shards - 1}) div {n_shards}")
    return cut.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Mixing sources to target weights by Pfair scheduling (built-in functions only).

A source of weight w is a task of rate w, its blocks of documents are the task's units, and a slot of the mix
takes one block. Block i may not start before floor((i - 1) / w) and must stand before ceil(i / w). In every
slot the released block with the earliest deadline goes first. Weights are whole parts of a period, so they sum
to one, the schedule is feasible and repeats each period: it is worked out for one period, as many rows as
there are parts, and block k of a source stands in slot (k - 1) div parts * period + its slot in the period.
After t slots each source has had within one block of w * t.

A source that has run out leaves its slots idle and the others keep their times, so the bound holds for every
source until its own end, and no document is dropped or repeated: those of a source with more than its share
come last, at their source's own rate.

Rows without a doc_id share one place in their source's order, so a source in which all lack it is ranked in one task.

Defined results: sources that no weight names, and null, share the stratum `rest`; a source's last block may be
short; the order within a source is seeded by doc_id, rows that repeat a doc_id stand together; an empty table
gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import set_aside
from quarry.llm.ranks import add_rank, range_bits, shuffle_key

#: Parts of a period by source; rest is what no other name takes.
TARGETS = {"src0": 12} | {f"src{i}": n for i, n in enumerate([6] * 4 + [4] * 5 + [3] * 5 + [2] * 5, 1)} | {"rest": 1}
BLOCK_ROWS, MAX_PERIOD = 32, 1 << 16
#: Names of columns that are made on the way.
OWN = {"stratum_", "key_", "rank_", "rank__total", "block_", "in_block_", "turn_", "plan_stratum_", "i_", "at_", "parts_", "slot_", "bucket_", "place_", "by_", "before_", "n_"}


def schedule(parts: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block in the period from 0, slot) of one period, earliest deadline first among released blocks."""
    period, done, out = sum(parts.values()), dict.fromkeys(parts, 0), []
    for slot in range(period):
        ready = [(-(-(done[s] + 1) * period // n), s) for s, n in parts.items() if done[s] < n and done[s] * period // n <= slot]
        deadline, s = min(ready)
        assert slot < deadline, "a feasible task set meets every deadline"
        out.append((s, done[s], slot))
        done[s] += 1
    return out


def add_slots(docs: DataFrame, targets: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, seed: str = "mix") -> DataFrame:
    """Adds stratum_, block_ (from 1), slot_ and in_block_ to all columns of docs."""
    parts = dict(targets or TARGETS)
    parts.setdefault("rest", 1)
    if min(parts.values()) < 1 or sum(parts.values()) > MAX_PERIOD:
        raise ValueError(f"weights are whole parts from 1, of a period up to {MAX_PERIOD}")
    named = [s for s in parts if s != "rest"]
    bits = range_bits(docs.count())

    def keyed(df: DataFrame) -> DataFrame:
        source = F.col("source").cast("string")
        return df.withColumn("stratum_", F.when(source.isin(named), source).otherwise("rest")).withColumn("key_", shuffle_key(seed, F.col("doc_id")))

    lead = F.shiftright(F.conv(F.substring("key_", 1, 5), 16, 10).cast("int"), 20 - bits)
    order = [F.col("key_"), F.xxhash64("text")]
    ranked = add_rank(keyed(docs), "stratum_", lead, order, "rank_", counted=keyed(docs.select("doc_id", "source")))
    blocks = ranked.withColumn("block_", F.expr(f"(rank_ - 1) div {block_rows} + 1")).withColumn("in_block_", F.expr(f"cast((rank_ - 1) % {block_rows} as int)"))
    rows = json.dumps([{"plan_stratum_": s, "i_": i, "at_": t, "parts_": parts[s]} for s, i, t in schedule(parts)])
    plan = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<plan_stratum_ string, i_ int, at_ int, parts_ int>>")))
    share = F.create_map(*[F.lit(x) for s, n in parts.items() for x in (s, n)])
    due = blocks.withColumn("turn_", F.expr("block_ - 1") % F.element_at(share, F.col("stratum_")))
    # the plan has at most MAX_PERIOD rows, so it may be broadcast whatever the documents are
    met = due.join(F.broadcast(plan), (F.col("stratum_") == F.col("plan_stratum_")) & (F.col("turn_") == F.col("i_")))
    slot = F.expr(f"(block_ - 1) div parts_ * {sum(parts.values())} + at_")
    return met.withColumn("slot_", slot).drop("key_", "rank_", "rank__total", "turn_", "plan_stratum_", "i_", "at_", "parts_")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """All rows with the columns of docs, in the order of the mix."""
    safe, named = set_aside(docs, OWN)
    return named(add_slots(safe, **options).repartitionByRange("slot_").sortWithinPartitions("slot_", "in_block_").select(*safe.columns))


def with_positions(docs: DataFrame, keep: tuple[str, ...], **options) -> DataFrame:
    """The columns in keep, text, and mix_slot and mix_place: where a row stands in the mix. It depends on the set of rows only, so
    rows that mixed() gave and that were written and read since get the places they had."""
    safe, _ = set_aside(docs, OWN)
    names = dict(zip(docs.columns, safe.columns))
    placed = add_slots(safe, **options)
    return placed.select(*[F.col(names[c]).alias(c) for c in (*keep, "text")], F.col("slot_").alias("mix_slot"), F.col("in_block_").alias("mix_place"))

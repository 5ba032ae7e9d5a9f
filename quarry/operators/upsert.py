"""Upserts with change detection, and syncing of tag columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERTED, UPDATED, UNCHANGED, KEPT = "inserted", "updated", "unchanged", "kept"


@dataclass
class Merged:
    """The new table, with what became of each row in `change_`."""

    marked: DataFrame

    @property
    def table(self) -> DataFrame:
        return self.marked.drop("change_")

    def counts(self) -> dict[str, int]:
        """How many incoming rows were inserted, updated and unchanged."""
        found = {r["change_"]: r["count"] for r in self.marked.groupBy("change_").count().collect()}
        return {k: found.get(k, 0) for k in (INSERTED, UPDATED, UNCHANGED)}


def last_of_each(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("last_", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("last_ = 1").drop("last_")


def comparable(column: Column, kind: str) -> Column:
    """Maps have no equality; their sorted entries have."""
    return F.array_sort(F.map_entries(column)) if kind.startswith("map<") else column


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str], skip: tuple[str, ...] = (), present: str | None = None) -> Merged:
    """Merges incoming rows into a table by a full outer join on the keys.

    A column that incoming has is written, nulls too; one that it lacks keeps its old value (null in a new row). present: an
    array column of incoming that names the columns a row has, where rows differ. Columns in skip are only written in new
    rows and don't count as changes. incoming must hold one row a key (see last_of_each)."""
    new_columns = [c for c in incoming.columns if c in table.columns and c not in keys]
    kinds = dict(table.dtypes)
    mine, theirs = table.withColumn("old_", F.lit(True)), incoming.withColumn("new_", F.lit(True))
    theirs = theirs.select(*[F.col(c).alias(f"{c}__in") for c in [*keys, *new_columns, *([present] if present else [])]], "new_")
    joined = mine.join(theirs, [mine[k] == theirs[f"{k}__in"] for k in keys], "full")

    def value(c: str) -> Column:
        arrives = F.col("new_").isNotNull()
        if present:
            arrives &= F.array_contains(f"{present}__in", c)
        if c in skip:
            arrives &= F.col("old_").isNull()
        return F.when(arrives, F.col(f"{c}__in").cast(kinds[c])).otherwise(F.col(c))

    out = [F.coalesce(c, f"{c}__in").alias(c) if c in keys else (value(c).alias(c) if c in new_columns else F.col(c)) for c in table.columns]
    same = F.lit(True)
    for c in new_columns:
        if c not in skip:
            same &= comparable(F.col(c), kinds[c]).eqNullSafe(comparable(value(c), kinds[c]))
    change = F.when(F.col("new_").isNull(), KEPT).when(F.col("old_").isNull(), INSERTED).when(same, UNCHANGED).otherwise(UPDATED)
    return Merged(joined.select(*out, change.alias("change_")))


def sync_flag_tags(cards: DataFrame, flags: dict[str, str], column: str = "card_is_tags") -> DataFrame:
    """Tags that stand for boolean columns (tag -> column) follow them; other tags stay."""
    managed, true = F.array(*map(F.lit, flags)), F.array_compact(F.array(*[F.when(F.col(flag), tag) for tag, flag in flags.items()]))
    return cards.withColumn(column, F.array_sort(F.array_union(F.array_except(column, managed), true)))


def add_tag(cards: DataFrame, ids: DataFrame, tag: str, key: str = "printing_id", column: str = "card_is_tags") -> DataFrame:
    """Adds a tag to the cards whose key is among ids, where they lack it."""
    marked = cards.join(ids.select(key).distinct().withColumn("tagged_", F.lit(True)), key, "left")
    return marked.withColumn(column, F.when(F.col("tagged_"), F.array_sort(F.array_union(column, F.array(F.lit(tag))))).otherwise(F.col(column))).select(*cards.columns)


def missing(wanted: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key no card has."""
    return wanted.join(cards.select(key).distinct(), key, "left_anti")

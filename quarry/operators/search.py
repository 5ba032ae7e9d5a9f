"""Search: filter editions, keep one per group, sort, page, count. All of it is one lazy plan."""

from __future__ import annotations

import functools
import random
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from enum import StrEnum, auto
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.compiler import compile_tree
from quarry.plans.explain import explain
from quarry.plans.rewrite import read
from quarry.plans.syntax import QueryError

DEFAULT_LIMIT = 100

# Result fields and the columns they show.
RESULT_FIELDS = {
    "name": "card_name",
    "set_code": "card_set_code",
    "collector_number": "collector_number",
    "power": "creature_power_text",
    "toughness": "creature_toughness_text",
    "mana_cost": "mana_cost_text",
    "oracle_text": "oracle_text",
    "set_name": "set_name",
    "type_line": "type_line",
    "illustration_id": "illustration_id",
    "scryfall_id": "printing_id",
    "price_usd": "price_usd",
    "prefer_score": "prefer_score",
}
EXTRA_FIELDS = {n: c for n, c in (("subtypes", "card_subtypes"), ("keywords", "card_keywords"), ("oracle_tags", "card_oracle_tags"), ("art_tags", "card_art_tags"), ("is_tags", "card_is_tags"), ("frame_data", "card_frame_data"))}
DEFAULT_FIELDS = tuple(RESULT_FIELDS)[:9]


class Unique(StrEnum):
    CARD = auto()
    PRINTING = auto()
    ARTWORK = auto()


class Prefer(StrEnum):
    DEFAULT = auto()
    OLDEST = auto()
    NEWEST = auto()
    USD_LOW = auto()
    USD_HIGH = auto()
    PROMO = auto()


class OrderBy(StrEnum):
    CMC = auto()
    CUBECOBRA = auto()
    EDHREC = auto()
    NAME = auto()
    POWER = auto()
    RARITY = auto()
    TOUGHNESS = auto()
    USD = auto()


class Direction(StrEnum):
    ASC = auto()
    DESC = auto()


class Shape(StrEnum):
    ROWS = auto()
    COLUMNAR = auto()


GROUPS = {Unique.CARD: ("oracle_id",), Unique.ARTWORK: ("oracle_id", "illustration_id")}
PREFERENCES = {
    Prefer.DEFAULT: ("prefer_score", Direction.DESC),
    Prefer.OLDEST: ("released_at", Direction.ASC),
    Prefer.NEWEST: ("released_at", Direction.DESC),
    Prefer.USD_LOW: ("price_usd", Direction.ASC),
    Prefer.USD_HIGH: ("price_usd", Direction.DESC),
    Prefer.PROMO: ("edhrec_rank", Direction.ASC),
}
SORTS = {
    OrderBy.CMC: "cmc",
    OrderBy.EDHREC: "edhrec_rank",
    OrderBy.NAME: "lower(card_name)",
    OrderBy.POWER: "creature_power",
    OrderBy.RARITY: "card_rarity_int",
    OrderBy.TOUGHNESS: "creature_toughness",
    OrderBy.USD: "price_usd",
    OrderBy.CUBECOBRA: "cubecobra_score",
}


def nulls_last(column: Column, direction: Direction) -> Column:
    return column.asc_nulls_last() if direction is Direction.ASC else column.desc_nulls_last()


def choice(kind: type[StrEnum], value: str, name: str) -> StrEnum:
    try:
        return kind(str(value).lower())
    except ValueError as e:
        raise QueryError(f"{name} is one of {', '.join(kind)}; got {value!r}") from e


@functools.lru_cache(maxsize=10_000)
def parsed(query: str):
    """Parsed and rewritten trees of recent queries; trees are immutable."""
    return read(query)


@functools.lru_cache(maxsize=1_000)
def condition(query: str, gaps: bool = False) -> Column:
    """The column of a recent query. It names columns and is bound to no table, so any search can use it again."""
    return compile_tree(parsed(query), gaps=gaps)


def matching(cards: DataFrame, query: str, gaps: bool = False) -> DataFrame:
    """The editions that a query matches. gaps: words of a text value may stand apart, in their order."""
    return cards.filter(condition(query, gaps))


@functools.lru_cache
def pick(unique: Unique, prefer: Prefer, within: tuple[str, ...] = ()) -> Column:
    """An edition's place in its group."""
    column, direction = PREFERENCES[prefer]
    order = [nulls_last(F.col(column), direction), *([F.col("prefer_score").desc_nulls_last()] if column != "prefer_score" else []), F.col("printing_id")]
    return F.row_number().over(Window.partitionBy(*within, *GROUPS[unique]).orderBy(*order))


def one_each(rows: DataFrame, unique: Unique, prefer: Prefer, hashed: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """One edition of each group: the preferred one. The first row of a group is cut on the map side, so a hot group costs a row a task.

    hashed: by an aggregation instead of a window, which gives the same rows. within: columns that tell groups apart too."""
    if unique is Unique.PRINTING:
        return rows
    if hashed:
        column, direction = PREFERENCES[prefer]
        # the same order as one comparable struct: false sorts before true, so nulls come last
        value = F.unix_date(column) if column == "released_at" else F.col(column).cast("double")
        signed = value if direction is Direction.ASC else -value
        best = F.struct(value.isNull(), signed, F.col("prefer_score").isNull(), -F.col("prefer_score"), F.col("printing_id"))
        return rows.groupBy(*within, *GROUPS[unique]).agg(F.min_by(F.struct(*rows.columns), best).alias("row_")).select("row_.*")
    return rows.withColumn("pick_", pick(unique, prefer, within)).filter("pick_ = 1").drop("pick_")


@functools.lru_cache
def sort_keys(orderby: OrderBy, direction: Direction) -> tuple[Column, ...]:
    ties = [] if orderby is OrderBy.EDHREC else [F.col("edhrec_rank").asc_nulls_last()]
    return (nulls_last(F.expr(SORTS[orderby]), direction), *ties, F.col("printing_id"))


def ordered(rows: DataFrame, orderby: OrderBy, direction: Direction) -> DataFrame:
    return rows.orderBy(*sort_keys(orderby, direction))


def paged(rows: DataFrame, limit: int | None, offset: int) -> DataFrame:
    if offset < 0 or limit is not None and limit < 0:
        raise QueryError("limit and offset can't be negative")
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


@functools.lru_cache
def field_columns(names: tuple[str, ...]) -> tuple[Column, ...]:
    known = RESULT_FIELDS | EXTRA_FIELDS
    if not names or (unknown := [n for n in names if n not in known]):
        raise QueryError("fields names no field" if not names else f"Unknown fields {unknown}")
    return tuple(F.col(known[n]).alias(n) for n in names)


def shown(rows: DataFrame, fields: Iterable[str] | None) -> DataFrame:
    return rows.select(*field_columns(tuple(dict.fromkeys(DEFAULT_FIELDS if fields is None else fields))))


def timed(run: Callable[[], Any]) -> tuple[Any, float]:
    """What run returns, and the milliseconds it took."""
    began = time.perf_counter()
    return run(), 1000 * (time.perf_counter() - began)


def held(cards: DataFrame) -> DataFrame:
    """cards in memory, dealt out by card and in order of preference, so that totals need no shuffle, nor do picks of cards and
    artworks; picks of cards by default preference need no sort either."""
    return cards.repartition("oracle_id").sortWithinPartitions("oracle_id", F.col("prefer_score").desc_nulls_last(), "printing_id").cache()


@dataclass
class Found:
    """A lazy result: the page, all matches (one per group), their groups, and what was asked."""

    page: DataFrame
    matches: DataFrame
    rows: DataFrame
    unique: Unique
    query: str
    params: dict = field(default_factory=dict)

    @functools.cached_property
    def groups(self) -> DataFrame:
        return self.rows if self.unique is Unique.PRINTING else self.rows.select(*GROUPS[self.unique]).distinct()

    @functools.cached_property
    def explanation(self) -> str:
        return explain(parsed(self.query))

    @functools.cached_property
    def compiled(self) -> str:
        return repr(condition(self.query)).removeprefix("Column<'").removesuffix("'>")

    def total(self) -> int:
        """How many matches there are; groups need no pick and no order, so they are counted."""
        return self.groups.count()

    def envelope(self, shape: str = Shape.ROWS) -> dict:
        """The page and total as plain values; the two jobs run side by side."""
        with ThreadPoolExecutor(2) as jobs:
            counting, paging = jobs.submit(timed, self.total), jobs.submit(timed, self.page.collect)
            (total, count_ms), (page, page_ms) = counting.result(), paging.result()
        rows = [r.asDict(recursive=True) for r in page]
        if choice(Shape, shape, "shape") is Shape.COLUMNAR:
            cards: object = {c: [r[c] for r in rows] for c in self.page.columns}
        else:
            cards = rows
        timings = {"page_ms": page_ms, "count_ms": count_ms}
        return {"cards": cards, "compiled": self.compiled, "params": self.params, "query": self.query, "query_explanation": self.explanation, "timings": timings, "total_cards": total}

    def explain(self) -> str:
        """Spark's formatted plan of the page."""
        return self.page._jdf.queryExecution().explainString(self.page.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def search(cards: DataFrame, query: str = "", unique: str = Unique.CARD, prefer: str = Prefer.DEFAULT, orderby: str = OrderBy.EDHREC, direction: str = Direction.ASC, limit: int | None = DEFAULT_LIMIT, offset: int = 0, fields: Iterable[str] | None = None) -> Found:
    """Cards that match a query. Raises QueryError for what can't be read or isn't offered."""
    unique, prefer, orderby, direction = choice(Unique, unique, "unique"), choice(Prefer, prefer, "prefer"), choice(OrderBy, orderby, "orderby"), choice(Direction, direction, "direction")
    rows = matching(cards, query)
    kept = one_each(rows, unique, prefer)
    page = shown(paged(ordered(kept, orderby, direction), limit, offset), fields)
    params = {"unique": unique, "prefer": prefer, "orderby": orderby, "direction": direction, "limit": limit, "offset": offset}
    return Found(page, kept, rows, unique, query, {k: str(v) if isinstance(v, StrEnum) else v for k, v in params.items()})


def search_many(cards: DataFrame, queries: list[str], unique: str = Unique.CARD, prefer: str = Prefer.DEFAULT, orderby: str = OrderBy.EDHREC, direction: str = Direction.ASC, limit: int = DEFAULT_LIMIT, fields: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages and totals of many queries, each from one scan: (query, position, fields) and (query, total_cards_count), by the query's place in
    the list. Every row is tested by all queries at once, so a scan's cost is shared."""
    unique, prefer, orderby, direction = choice(Unique, unique, "unique"), choice(Prefer, prefer, "prefer"), choice(OrderBy, orderby, "orderby"), choice(Direction, direction, "direction")
    hits = F.array_compact(F.array(*[F.when(condition(q), F.lit(i)) for i, q in enumerate(queries)]))
    rows = cards.select("*", F.explode(hits).alias("query"))
    kept = one_each(rows, unique, prefer, within=("query",))
    place = F.row_number().over(Window.partitionBy("query").orderBy(*sort_keys(orderby, direction)))
    page = kept.withColumn("position", place).filter(F.col("position") <= limit)
    page = page.select("query", "position", *[F.col((RESULT_FIELDS | EXTRA_FIELDS)[n]).alias(n) for n in shown(cards, fields).columns])
    groups = rows.select("query", "printing_id") if unique is Unique.PRINTING else rows.select("query", *GROUPS[unique]).distinct()
    counted = groups.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    every = cards.sparkSession.range(len(queries)).select(F.col("id").cast("int").alias("query"))
    return page, every.join(counted, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("total_cards_count"))


def total_and_page(found: Found) -> DataFrame:
    """One DataFrame of the total (null on rows) and the page (null on the total)."""
    count = found.groups.agg(F.count(F.lit(1)).alias("total_cards_count"))
    return found.page.withColumn("total_cards_count", F.lit(None).cast("long")).unionByName(count, allowMissingColumns=True)


def browse(cards: DataFrame, after: str | None = None, before: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Editions by name, strictly between two names."""
    if after is not None:
        cards = cards.filter(F.col("card_name") > after)
    if before is not None:
        cards = cards.filter(F.col("card_name") < before)
    return cards.orderBy("card_name", "printing_id").limit(limit)


SAMPLE_AT_ONCE = 1000  # rows that a sort with a limit may bring into one task


def random_sample(cards: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """n distinct cards, each by its preferred edition; all, if there are no more.

    A large sample is cut where counts of the draw's leading bits reach n, so that only the cards of one such bucket are sorted."""
    if n < 1:
        raise QueryError("a sample has at least one card")
    kept = one_each(cards, Unique.CARD, Prefer.DEFAULT)
    if n <= SAMPLE_AT_ONCE:
        draw = F.rand() if seed is None else F.xxhash64(F.lit(seed), "oracle_id")
        return kept.orderBy(draw, "oracle_id").limit(n)
    # two parts have to see the same draw, so it is always by a seed
    draw = F.xxhash64(F.lit(random.getrandbits(31) if seed is None else seed), "oracle_id")
    bucket, before = F.shiftright(draw, 48), 0
    for at, many in sorted(cards.select("oracle_id").distinct().groupBy(bucket.alias("bucket")).count().collect()):
        if before + many > n:
            return kept.filter(bucket < at).unionByName(kept.filter(bucket == at).orderBy(draw, "oracle_id").limit(n - before))
        before += many
    return kept

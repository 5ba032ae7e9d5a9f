"""One object over a catalogue of editions: queries, catalogues, samples, and reloads that publish whole tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import catalogs
from quarry.operators.search import Prefer, QueryError, Unique, held, one_each, random_sample, search
from quarry.sources.bulk import publish, published


class SearchEngine:
    """Serves the table at a path. Readers see the old table until a reload commits, then the new one."""

    def __init__(self, spark: SparkSession, path: str, cached: bool = True):
        self.spark, self.path, self.cached = spark, path, cached
        self.cards: DataFrame | None = None
        self._batches: list[DataFrame] | None = None

    def open(self) -> SearchEngine:
        """Reads the published table. The new one is in memory before it takes the old one's place, and queries that still run on
        the old one can go back to its files."""
        fresh, old = published(self.spark, self.path), self.cards
        if self.cached:
            fresh = held(fresh)
            fresh.count()
        self.cards = fresh
        if old is not None and self.cached:
            old.unpersist()
        return self

    def _open_cards(self) -> DataFrame:
        return self.cards if self.cards is not None else self.open().cards

    def size(self) -> int:
        return self._open_cards().count()

    def query(self, query: str = "", shape: str = "rows", **params) -> dict:
        return search(self._open_cards(), query, **params).envelope(shape)

    def explain(self, query: str = "", **params) -> str:
        return search(self._open_cards(), query, **params).explain()

    def explain_analyze(self, query: str = "", **params) -> dict:
        """The plan, after it ran, with what it took and found."""
        found, began = search(self._open_cards(), query, **params), time.perf_counter()
        rows = len(found.page.collect())
        return {"plan": found.explain(), "rows": rows, "total_ms": 1000 * (time.perf_counter() - began), "total_cards": found.total()}

    def sample_preferred(self, n: int, seed: int | None = None) -> DataFrame:
        if n > 1000:
            raise QueryError("a sample has 1 to 1000 cards")
        return random_sample(self._open_cards(), n, seed)

    def common_card_types(self) -> DataFrame:
        return catalogs.common_types(self._open_cards())

    def common_card_keywords(self) -> DataFrame:
        return catalogs.common_keywords(self._open_cards())

    def preferred(self) -> DataFrame:
        """One edition a card, which default searches and catalogues could start from."""
        return one_each(self._open_cards(), Unique.CARD, Prefer.DEFAULT)

    def reload(self, cards: DataFrame) -> int:
        """Publishes a table and opens it."""
        self.reload_begin()
        self.add_batch(cards)
        return self.reload_commit()

    def reload_begin(self) -> None:
        self._batches = []

    def add_batch(self, cards: DataFrame) -> None:
        if self._batches is None:
            raise ValueError("no reload has begun")
        self._batches.append(cards)

    def reload_commit(self) -> int:
        """Publishes all batches as one table."""
        if not self._batches:
            raise ValueError("a reload has no batch")
        every = self._batches[0]
        for more in self._batches[1:]:
            every = every.unionByName(more)
        publish(every, self.path)
        self._batches = None
        return self.open().size()

    def reload_abort(self) -> None:
        self._batches = None

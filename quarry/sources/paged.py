"""Paged listings: JSON pages of `data` and `next_page`, followed from page to page or saved one file a page in a folder."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.sources.bulk import CARD_SCHEMA


def read_pages(spark: SparkSession, folder: str, schema: str = CARD_SCHEMA) -> DataFrame:
    """The objects of all pages, read in parallel. A missing folder is an empty result; a page that can't be read has no objects."""
    try:
        pages = spark.read.text(folder, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return objects(pages, schema)


def objects(pages: DataFrame, schema: str) -> DataFrame:
    """The objects of pages, whose texts are in the column value."""
    columns = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in pages.sparkSession.createDataFrame([], schema).schema)
    parsed = pages.select(F.from_json("value", f"data ARRAY<STRUCT<{columns}>>").alias("page"))
    return parsed.select(F.inline("page.data"))


def fetch(url: str, tries: int = 3, pause: float = 0.2) -> str | None:
    """A page's text; None if there is no such page. Other errors are tried again, then raised."""
    for n in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            if n == tries - 1:
                raise
        except urllib.error.URLError as e:
            if isinstance(e.reason, FileNotFoundError):
                return None
            if n == tries - 1:
                raise
        time.sleep(pause * 2**n)
    return None


class ListingReader(DataSourceReader):
    """One task a listing, since a page says where the next one is."""

    def __init__(self, urls: list[str]):
        self.urls = urls

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        url, seen = partition.value, set()
        while url and url not in seen:
            seen.add(url)
            text = fetch(url)
            if text is None:
                return
            yield url, text
            try:
                further = json.loads(text).get("next_page")
            except (ValueError, AttributeError):
                return
            url = further if isinstance(further, str) else None


class ListingSource(DataSource):
    """Format `quarry_listing`; the option urls holds first pages, one a line."""

    @classmethod
    def name(cls) -> str:
        return "quarry_listing"

    def schema(self) -> str:
        return "url STRING, value STRING"

    def reader(self, schema) -> ListingReader:
        return ListingReader([u for u in self.options["urls"].split("\n") if u])


def follow_pages(spark: SparkSession, urls: list[str], schema: str = CARD_SCHEMA) -> DataFrame:
    """The objects of listings, from their first pages on; a page that isn't there ends its listing, a missing listing is empty."""
    if not urls:
        return spark.createDataFrame([], schema)
    spark.dataSource.register(ListingSource)
    return objects(spark.read.format("quarry_listing").option("urls", "\n".join(urls)).load(), schema)

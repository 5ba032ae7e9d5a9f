"""Frequency catalogues of types, keywords and words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.search import Prefer, Unique, one_each


def type_counts(cards: DataFrame) -> DataFrame:
    """t, n: how many editions carry each type or subtype. Both lists are exploded in one pass."""
    both = F.concat(F.coalesce("card_types", F.array().cast("array<string>")), F.coalesce("card_subtypes", F.array().cast("array<string>")))
    return cards.select(F.explode(both).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).orderBy("t")


def keyword_counts(cards: DataFrame, least: int = 5) -> DataFrame:
    """k, n: keywords that at least `least` editions carry."""
    return cards.select(F.explode("card_keywords").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy("k")


def common_types(cards: DataFrame) -> DataFrame:
    """type_counts over preferred editions, with the old name of a type counted under the new one."""
    rename = lambda t: F.when(t == "Tribal", F.lit("Kindred")).otherwise(t)
    return type_counts(one_each(cards, Unique.CARD, Prefer.DEFAULT).withColumn("card_types", F.array_distinct(F.transform("card_types", rename))))


def common_keywords(cards: DataFrame) -> DataFrame:
    """keyword_counts over preferred editions."""
    return keyword_counts(one_each(cards, Unique.CARD, Prefer.DEFAULT), 1)


def artwork_counts(cards: DataFrame) -> DataFrame:
    """illustration_id, card_name, printings: English editions of real sets, by artwork."""
    real = F.col("illustration_id").isNotNull() & (F.col("lang") == "en") & (F.coalesce("set_type", F.lit("")) != "memorabilia") & ~F.coalesce("card_border", F.lit("")).isin("gold", "yellow")
    return cards.filter(real).groupBy("illustration_id", "card_name").agg(F.count(F.lit(1)).alias("printings"))


def word_counts(rows: DataFrame, column: str, shortest: int = 4, least: int = 30, most: int = 4000) -> DataFrame:
    """word, n: the most frequent words of a text column; a text counts a word once."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(f"[\\p{{L}}]{{{shortest},}}"), F.lit(0)))
    counted = rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)


def completion(catalog: DataFrame, prefix: str, word: str = "t", count: str = "n") -> DataFrame:
    """The most frequent entry that starts with a prefix, ties to the first in order."""
    found = catalog.filter(F.startswith(F.lower(word), F.lit(prefix.lower())))
    return found.agg(F.min_by(word, F.struct(-F.col(count), F.col(word))).alias("completion"))


def quantile(rows: DataFrame, column: str, p: float) -> DataFrame:
    """The exact p-th quantile of a column."""
    return rows.agg(F.percentile(column, F.lit(p)).alias("quantile"))

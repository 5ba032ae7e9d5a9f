"""Scores: which edition of a card to prefer, and how popular a card is."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.catalogs import artwork_counts
from quarry.operators.lineage import cut_lineage

# Weights of the preference components; a rarity's and a frame's weight goes by its value.
ARTWORK_SCALE = 40
WEIGHTS = {
    "illustration_count": 23, "rarity_0": 16, "rarity_1": 16, "rarity_2": 11, "border": 14, "frame_2015": 42, "frame_2003": 30, "frame_1997": 25, "frame_1993": 10, "extended_art": 12, "highres_scan": 16, "has_paper": 6,
    "language": 40, "legendary_frame": 5, "non_showcase": 10, "nonfoil": 10, "foil": 5, "artwork_set": 20, "art_style": 14,
}
ART_EXEMPT = ("dungeons-and-dragons", "the-lord-of-the-rings")
ART_OFF = ("anime", "comic-style", "line-art", "word-art-title")
POPULARITY = {"edhrec_rank": 1.0, "cubecobra_elo": 1.0, "cubecobra_cube_count": 1.0, "cubecobra_pick_count": 1.0}


def components(weights: dict[str, float] | None = None) -> dict[str, Column]:
    """The thirteen components as columns, any weight of which can be another; `printings` is the artwork's count."""
    if unknown := set(weights or {}) - set(WEIGHTS):
        raise ValueError(f"no such weights: {', '.join(sorted(unknown))}")
    weights = WEIGHTS | (weights or {})
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    has = lambda column, value: F.array_contains(F.coalesce(column, F.array().cast("array<string>")), value)
    tags = F.coalesce(F.col("card_art_tags"), F.array().cast("array<string>"))
    among = lambda names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    pick = lambda cases: functools.reduce(lambda chain, c: chain.when(c[0], c[1]), cases[1:], F.when(*cases[0])).otherwise(0)
    count = F.coalesce("printings", F.lit(0))
    return {
        "illustration_count": F.round(weights["illustration_count"] * F.ln(1 + count) / F.ln(F.lit(ARTWORK_SCALE)), 4),
        "rarity": pick([(F.col("card_rarity_int") == r, weights[f"rarity_{r}"]) for r in range(3)]),
        "border": points(F.col("card_border") == "black", weights["border"]),
        "frame": pick([(has("card_frame_data", f), weights[f"frame_{f}"]) for f in ("2015", "2003", "1997", "1993")]),
        "extended_art": points(has("card_frame_data", "Extendedart"), weights["extended_art"]),
        "highres_scan": points(F.col("image_status") == "highres_scan", weights["highres_scan"]),
        "has_paper": points(has("games", "paper"), weights["has_paper"]),
        "language": points(F.col("lang") == "en", weights["language"]),
        "legendary_frame": points(has("frame_effects", "legendary"), weights["legendary_frame"]),
        "non_showcase": points(~has("frame_effects", "showcase"), weights["non_showcase"]),
        "finish": pick([(has("finishes", "nonfoil"), weights["nonfoil"]), (has("finishes", "foil"), weights["foil"])]),
        "artwork_set": points(~F.coalesce(F.col("card_set_code") == "dbl", F.lit(False)), weights["artwork_set"]),
        "art_style": points(~((F.array_contains(tags, "external-ip") & ~among(ART_EXEMPT)) | among(ART_OFF)), weights["art_style"]),
    }


def prefer_scores(cards: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """cards with prefer_score_components (a map) and prefer_score. Artworks are counted once and joined; the plan picks how."""
    cards = cards.drop("prefer_score_components", "prefer_score")
    counted = cards.join(artwork_counts(cards), ["illustration_id", "card_name"], "left")
    parts = {name: c.cast("double") for name, c in components(weights).items()}
    scored = counted.withColumn("prefer_score_components", F.create_map(*[x for name, c in parts.items() for x in (F.lit(name), c)]))
    total = functools.reduce(operator.add, [F.element_at("prefer_score_components", F.lit(name)) for name in parts])
    return scored.withColumn("prefer_score", total).drop("printings")


def percent_ranks(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, order and rank: the percent rank of each value of `order` (ascending) among the rows of its `by`, one row a value.

    Equal values are folded first, so a hot one costs a row; the values are dealt out by ranges of the order and counts put one
    range behind the other, so no task sees them all."""
    values = rows.groupBy(by, *order).agg(F.count(F.lit(1)).alias("n_"))
    ranged = cut_lineage(values.repartitionByRange(by, *order).withColumn("range_", F.spark_partition_id()))
    sizes = ranged.groupBy(by, "range_").agg(F.sum("n_").alias("n_"))  # a row a range
    sums = lambda over: F.coalesce(F.sum("n_").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(by, "range_", sums(Window.partitionBy(by).orderBy("range_")).alias("before_"), F.sum("n_").over(Window.partitionBy(by)).alias("all_"))
    placed = ranged.withColumn("inside_", sums(Window.partitionBy(by, "range_").orderBy(*order))).join(offsets, [by, "range_"])
    return placed.select(by, *order, ((F.col("before_") + F.col("inside_")) / F.greatest(F.col("all_") - 1, F.lit(1))).alias("rank"))


def popularity(cards: DataFrame, weights: dict[str, float] = POPULARITY) -> DataFrame:
    """card_name, cubecobra_score: percent ranks of a card's measures, weighted to 0 (best) to 100.

    One row a name goes into the ranks (its first edition by id); all measures are ranked in one pass. Missing values come last."""
    first = F.min_by(F.struct(*weights), "printing_id").alias("first")
    names = cards.groupBy("card_name").agg(first).select("card_name", "first.*")
    signed = [F.col(c).cast("double") * (1 if c == "edhrec_rank" else -1) for c in weights]
    measures = F.array(*[F.struct(F.lit(i).alias("measure"), c.isNull().alias("absent"), F.coalesce(c, F.lit(0.0)).alias("value")) for i, c in enumerate(signed)])
    long = cut_lineage(names.select("card_name", F.inline(measures)))
    ranked = long.join(percent_ranks(long, "measure", ["absent", "value"]), ["measure", "absent", "value"])
    own = ranked.groupBy("card_name").agg(*[F.max(F.when(F.col("measure") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(weights))])
    total = sum(weights.values())
    score = functools.reduce(operator.add, [F.col(f"rank_{i}") * (100 * w / total) for i, w in enumerate(weights.values())])
    return own.select("card_name", score.alias("cubecobra_score"))


def with_popularity(cards: DataFrame, weights: dict[str, float] = POPULARITY) -> DataFrame:
    """cards with cubecobra_score."""
    return cards.drop("cubecobra_score").join(popularity(cards, weights), "card_name", "left")


def with_ranking(cards: DataFrame, ranking: DataFrame) -> DataFrame:
    """cards with measures from a ranking dump (oracle_id, elo, cubeCount, pickCount); unknown ids are dropped, others keep theirs."""
    names = {"elo": "cubecobra_elo", "cubeCount": "cubecobra_cube_count", "pickCount": "cubecobra_pick_count"}
    known = ranking.filter("oracle_id IS NOT NULL").dropDuplicates(["oracle_id"]).select("oracle_id", F.lit(True).alias("ranked_"), *[F.col(a).alias(f"{b}_") for a, b in names.items()])
    joined = cards.join(known, "oracle_id", "left")
    for column in names.values():
        joined = joined.withColumn(column, F.when(F.col("ranked_"), F.col(f"{column}_")).otherwise(F.col(column)))
    return joined.drop("ranked_", *[f"{c}_" for c in names.values()])


def position_agreement(left: DataFrame, right: DataFrame, key: str = "card_name", position: str = "position") -> DataFrame:
    """Mean of 1 - |difference of positions| / the longer list, over what both list."""
    size = F.greatest(left.agg(F.count(F.lit(1)).alias("n")).select("n").scalar(), right.agg(F.count(F.lit(1)).alias("n")).select("n").scalar())
    both = left.select(key, F.col(position).alias("a")).join(right.select(key, F.col(position).alias("b")), key)
    return both.select(F.avg(1 - F.abs(F.col("a") - F.col("b")) / size).alias("agreement"))

"""Raw objects to searchable editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.colors import mask_column
from quarry.functions.mana import devotion_column, pips_column
from quarry.functions.text import digits_int, folded, titled
from quarry.plans.fields import RARITIES

# Types that stay in play, types that aren't cards, and flags that become is-tags.
PERMANENTS = ("Artifact", "Battle", "Creature", "Enchantment", "Land", "Planeswalker")
NOT_CARDS = ("Card", "Token")
MOBILE = ("Vehicle", "Spacecraft")
FLAG_TAGS = {"reserved": "reserved", "gamechanger": "game_changer"}

NO_STRINGS = "CAST(array() AS ARRAY<STRING>)"


def strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.expr(NO_STRINGS))


def eligible(raw: DataFrame) -> DataFrame:
    """Objects that are playable cards on paper."""
    statuses = F.map_values(F.coalesce("legalities", F.create_map().cast("map<string,string>")))
    playable = F.exists(statuses, lambda s: s.isin("legal", "restricted"))
    halves = F.split("name", "//", 2)
    same_halves = F.coalesce((F.size(halves) == 2) & (F.trim(halves[0]) == F.trim(F.get(halves, 1))), F.lit(False))
    return raw.filter(playable & ~F.array_contains(strings("promo_types"), "playtest") & F.array_contains(strings("games"), "paper") & (F.coalesce("set_type", F.lit("")) != "funny") & ~same_halves)


def faces(raw: DataFrame) -> DataFrame:
    """One row a face, numbered from 1; what a face says goes before what its object says. card_name stays the object's."""
    exploded = raw.withColumn("card_name", F.col("name")).select("*", F.posexplode_outer("card_faces").alias("at_", "face_")).drop("card_faces")
    for column in raw.schema["card_faces"].dataType.elementType.fieldNames():
        exploded = exploded.withColumn(column, F.coalesce(F.col(f"face_.{column}"), F.col(column)))
    return exploded.withColumn("face_idx", F.coalesce(F.col("at_") + 1, F.lit(1))).withColumn("face_name", F.col("name")).drop("at_", "face_")


def type_words(line: Column, part: int) -> Column:
    """Words before (0) or after (1) the dash of a title-cased type line."""
    return F.filter(F.split(F.trim(F.coalesce(F.get(F.split(line, "—", 2), part), F.lit(""))), r"\s+"), lambda w: w != "")


def whole(text: Column) -> Column:
    """A number's whole part; null if the text isn't a number."""
    return text.try_cast("double").try_cast("int")


def editions(raw: DataFrame, all_faces: bool = False) -> DataFrame:
    """Editions from raw objects: eligible, one row a face, derived columns.

    By default the front face stands for its edition, so that ids stay unique; all_faces keeps every one."""
    rows = faces(eligible(raw))
    if not all_faces:
        rows = rows.filter("face_idx = 1")
    line = titled(F.col("type_line"))
    rows = rows.withColumn("line_", line).withColumn("card_types", type_words(F.col("line_"), 0)).withColumn("card_subtypes", type_words(F.col("line_"), 1))
    rows = rows.filter(~F.arrays_overlap("card_types", F.array(*map(F.lit, NOT_CARDS))))
    has_body = F.array_contains("card_types", "Creature") | F.arrays_overlap("card_subtypes", F.array(*map(F.lit, MOBILE)))
    stays = F.arrays_overlap("card_types", F.array(*map(F.lit, PERMANENTS)))
    rarity = F.array_position(F.array(*map(F.lit, RARITIES)), F.lower("rarity")).cast("int") - 1
    effects = F.transform(strings("frame_effects"), F.initcap)
    flags = F.array_compact(F.array(*[F.when(F.col(flag), tag) for tag, flag in FLAG_TAGS.items()]))
    return rows.select(
        F.col("id").alias("printing_id"), "oracle_id", "illustration_id", "face_idx", "face_name", "card_name",
        folded(F.lower("card_name")).alias("card_name_folded"),
        F.coalesce("oracle_text", F.lit("")).alias("oracle_text"), F.coalesce("flavor_text", F.lit("")).alias("flavor_text"),
        "type_line", "card_types", "card_subtypes", F.col("mana_cost").alias("mana_cost_text"), pips_column(F.col("mana_cost")).alias("mana_cost_jsonb"),
        F.when(stays, devotion_column(F.col("mana_cost"))).otherwise(F.create_map().cast("map<string,int>")).alias("devotion"),
        F.col("cmc").cast("int").alias("cmc"),
        F.when(has_body, whole(F.col("power"))).alias("creature_power"), F.when(has_body, whole(F.col("toughness"))).alias("creature_toughness"),
        F.when(has_body, F.col("power")).alias("creature_power_text"), F.when(has_body, F.col("toughness")).alias("creature_toughness_text"),
        whole(F.col("loyalty")).alias("planeswalker_loyalty"), F.col("loyalty").alias("planeswalker_loyalty_text"),
        mask_column(F.col("colors")).alias("card_colors"), mask_column(F.col("color_identity")).alias("card_color_identity"), mask_column(F.col("produced_mana")).alias("produced_mana"),
        F.array_sort(F.array_distinct(F.transform(strings("keywords"), F.lower))).alias("card_keywords"),
        F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(F.initcap("frame"))), effects))).alias("card_frame_data"),
        F.expr(NO_STRINGS).alias("card_oracle_tags"), F.expr(NO_STRINGS).alias("card_art_tags"), flags.alias("card_is_tags"),
        *[F.col(f"prices.{c}").try_cast("decimal(10,2)").alias(f"price_{c}") for c in ("usd", "eur", "tix")],
        F.lower("set").alias("card_set_code"), "set_name", "set_type", F.lower("layout").alias("card_layout"), F.lower("border_color").alias("card_border"), F.lower("watermark").alias("card_watermark"),
        F.lower("rarity").alias("card_rarity_text"), rarity.alias("card_rarity_int"), "collector_number", digits_int(F.col("collector_number")).alias("collector_number_int"),
        F.col("artist").alias("card_artist"), "edhrec_rank", "released_at", F.col("legalities").alias("card_legalities"),
        "lang", "games", "finishes", "image_status", "frame_effects", "reserved", "game_changer",
        F.lit(None).cast("double").alias("cubecobra_elo"), F.lit(None).cast("int").alias("cubecobra_cube_count"), F.lit(None).cast("int").alias("cubecobra_pick_count"), F.lit(None).cast("double").alias("cubecobra_score"),
        F.lit(None).cast("double").alias("prefer_score"),
    )


#: Quality checks: a name and the condition that a row breaks.
CHECKS = {
    "colors": "card_colors & ~63 <> 0 OR card_color_identity & ~63 <> 0 OR produced_mana & ~63 <> 0",
    "lower_case": "card_border <> lower(card_border) OR card_layout <> lower(card_layout) OR card_watermark <> lower(card_watermark)",
    "body": "creature_power IS NOT NULL AND NOT array_contains(card_types, 'Creature') AND NOT arrays_overlap(card_subtypes, array('Vehicle', 'Spacecraft'))",
    "rarity": "card_rarity_int NOT BETWEEN 0 AND 5",
    "keys": "printing_id IS NULL OR oracle_id IS NULL",
}


def quality(cards: DataFrame) -> DataFrame:
    """check, broken: rows that break each check, in one pass."""
    counts = [F.count(F.when(F.expr(condition), 1)).alias(name) for name, condition in CHECKS.items()]
    return cards.agg(*counts).unpivot([], list(CHECKS), "check", "broken")


def least_rows(cards: DataFrame, least: int) -> DataFrame:
    """cards, if there are at least so many (a gate before publishing). Raises ValueError."""
    if cards.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows")
    return cards

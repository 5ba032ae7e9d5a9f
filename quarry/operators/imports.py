"""Whole runs: from dumps to a published table, and re-scoring of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import ingest, scores, tags, upsert
from quarry.operators.lineage import cut_lineage, new_folder
from quarry.sources import bulk

#: Columns that other steps than the ingest fill.
LATER = ("card_oracle_tags", "card_art_tags", "cubecobra_elo", "cubecobra_cube_count", "cubecobra_pick_count", "cubecobra_score", "prefer_score")


def import_cards(spark: SparkSession, cards_path: str, table_path: str, oracle_tags: str | None = None, art_tags: str | None = None, ranking: str | None = None, least: int = 1) -> dict[str, int]:
    """Dump to editions, gate, upsert into what is published, tags, ranking, scores, publication. Returns what became of the dump's rows.

    Nothing is published if the dump can't be read well enough or has too few rows; readers go on with the version before."""
    raw = bulk.load_dump(spark, cards_path, new_folder(spark, "raw"))
    fresh = ingest.least_rows(ingest.editions(raw), least)
    fresh = upsert.last_of_each(fresh, ["printing_id"], F.col("released_at"))
    if bulk.current(spark, table_path) is None:
        table, counts = fresh, {"inserted": fresh.count(), "updated": 0, "unchanged": 0}
    else:
        old = bulk.published(spark, table_path).drop("prefer_score_components")
        merged = upsert.upsert(old, fresh.drop(*LATER), ["printing_id"])
        table, counts = merged.table, merged.counts()
    for path, kind, key, column in ((oracle_tags, bulk.Dump.ORACLE_TAGS, "oracle_id", "card_oracle_tags"), (art_tags, bulk.Dump.ART_TAGS, "illustration_id", "card_art_tags")):
        if path is not None:
            dump = bulk.load_dump(spark, path, new_folder(spark, kind), kind)
            table, _ = tags.sync_tags(table, tags.item_tags(dump, key), key, column)
    table = upsert.sync_flag_tags(table, ingest.FLAG_TAGS)
    if ranking is not None:
        table = scores.with_ranking(table, bulk.read_dump(spark, ranking, schema=bulk.RANKING_SCHEMA))
    bulk.publish(scored(cut_lineage(table)), table_path)
    return counts


def scored(table: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The table with popularity and preference scores."""
    return scores.prefer_scores(scores.with_popularity(table), weights)


def rescore(spark: SparkSession, table_path: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Publishes what is published with scores by other weights."""
    return bulk.publish(scored(bulk.published(spark, table_path).drop("prefer_score_components"), weights), table_path)

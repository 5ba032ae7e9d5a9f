"""Bulk dumps of raw objects: JSON lines, optionally compressed, and JSON sinks."""

from __future__ import annotations

import time
from enum import StrEnum

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Dump(StrEnum):
    """Kinds of dump that a catalogue publishes."""

    ALL_CARDS = "all_cards"
    ART_TAGS = "art_tags"
    DEFAULT_CARDS = "default_cards"
    ORACLE_CARDS = "oracle_cards"
    ORACLE_TAGS = "oracle_tags"
    RULINGS = "rulings"
    UNIQUE_ARTWORK = "unique_artwork"


_FACE = """name STRING, type_line STRING, oracle_text STRING, flavor_text STRING, mana_cost STRING, power STRING, toughness STRING, loyalty STRING,
colors ARRAY<STRING>, artist STRING, illustration_id STRING, watermark STRING"""
CARD_SCHEMA = f"""id STRING, oracle_id STRING, name STRING, type_line STRING, oracle_text STRING, flavor_text STRING, mana_cost STRING, cmc DOUBLE,
power STRING, toughness STRING, loyalty STRING, colors ARRAY<STRING>, color_identity ARRAY<STRING>, keywords ARRAY<STRING>, produced_mana ARRAY<STRING>,
legalities MAP<STRING, STRING>, prices STRUCT<usd: STRING, eur: STRING, tix: STRING>, `set` STRING, set_name STRING, set_type STRING, layout STRING,
border_color STRING, watermark STRING, frame STRING, frame_effects ARRAY<STRING>, rarity STRING, collector_number STRING, artist STRING,
illustration_id STRING, edhrec_rank INT, released_at DATE, games ARRAY<STRING>, promo_types ARRAY<STRING>, finishes ARRAY<STRING>, image_status STRING,
lang STRING, reserved BOOLEAN, game_changer BOOLEAN, card_faces ARRAY<STRUCT<{", ".join(p.strip().replace(" ", ": ", 1) for p in _FACE.split(","))}>>"""
TAG_SCHEMA = "id STRING, slug STRING, parent_ids ARRAY<STRING>, taggings ARRAY<STRUCT<oracle_id: STRING, illustration_id: STRING>>"
RANKING_SCHEMA = "oracle_id STRING, elo DOUBLE, cubeCount INT, pickCount INT"
SCHEMAS = {Dump.ORACLE_TAGS: TAG_SCHEMA, Dump.ART_TAGS: TAG_SCHEMA, Dump.RULINGS: "oracle_id STRING, published_at DATE, comment STRING"}
CORRUPT = "corrupt_"


class CoverageError(ValueError):
    """Too many lines of a dump can't be read."""


def parse_dump(spark: SparkSession, path: str, dump: str, schema: str | None, multiline: bool) -> DataFrame:
    """All lines' objects, with what can't be read in the last column."""
    columns = schema or SCHEMAS.get(Dump(dump), CARD_SCHEMA)
    lines = spark.read.text(path, wholetext=multiline).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{columns}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("row")).select("row.*")


def covered(path: str, total: int, bad: int, coverage: float) -> None:
    if bad > (1 - coverage) * total:
        raise CoverageError(f"{bad} of {total} lines of {path} can't be read")


def read_dump(spark: SparkSession, path: str, dump: str = Dump.DEFAULT_CARDS, schema: str | None = None, coverage: float = 0.99, multiline: bool = False) -> DataFrame:
    """Rows of a dump with a declared schema. Bad lines are left out; if more than 1 - coverage are bad, CoverageError.

    Compressed files are read by their suffix. Files that hold one object over many lines need multiline. Lines are counted first
    and parsed again by whoever uses the rows; load_dump parses once."""
    parsed = parse_dump(spark, path, dump, schema, multiline)
    if coverage > 0:
        covered(path, *parsed.agg(F.count(F.lit(1)), F.count(CORRUPT)).first(), coverage)
    return parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def load_dump(spark: SparkSession, path: str, target: str, dump: str = Dump.DEFAULT_CARDS, schema: str | None = None, coverage: float = 0.99, multiline: bool = False) -> DataFrame:
    """Like read_dump, but parses the dump once: rows are written to a folder while they are counted, and read from there."""
    seen = Observation()
    parsed = parse_dump(spark, path, dump, schema, multiline).observe(seen, F.count(F.lit(1)).alias("total"), F.count(CORRUPT).alias("bad"))
    parsed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT).write.mode("overwrite").parquet(target)
    covered(path, seen.get["total"], seen.get["bad"], coverage)
    return spark.read.parquet(target)


def dump_path(root: str, dump: str) -> str:
    """Where a dump lies under a root folder."""
    return f"{root.rstrip('/')}/{Dump(dump)}"


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as JSON lines, in folders by a column if one is named."""
    (rows.write.partitionBy(by) if by else rows.write).mode("overwrite").json(path)


POINTER = "CURRENT"
KEPT = 2  # versions: the one that is read, and the one before, which readers may still be in


def _at(spark: SparkSession, path: str) -> tuple:
    """Spark's own file system for a path, and a way to name paths."""
    name = spark._jvm.org.apache.hadoop.fs.Path
    return name(path).getFileSystem(spark._jsc.hadoopConfiguration()), name


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the published version, if there is one."""
    fs, name = _at(spark, path)
    pointer = name(f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return None
    return f"{path}/{spark.read.text(pointer.toString()).first()[0]}"


def published(spark: SparkSession, path: str) -> DataFrame:
    """The table that publish() left at a path."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(version)


def publish(cards: DataFrame, path: str, cluster: tuple[str, ...] = ("oracle_id",)) -> DataFrame:
    """Writes a new version of a table into a folder of its own, then points to it. The pointer is one small file that is replaced
    by one rename, so there is a whole table at any time, also if this fails midway; readers of the version before
    keep its files until the next publication.

    Rows are dealt out and sorted by the card's key, so that a group lies in one file, its rows together. A hash needs no
    sample of the keys first, as ranges would."""
    spark = cards.sparkSession
    fs, name = _at(spark, path)
    version = f"v-{time.time_ns():020d}"
    cards.repartition(*cluster).sortWithinPartitions(*cluster).write.parquet(f"{path}/{version}")
    fresh = name(f"{path}/.{POINTER}.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    how = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fs.makeQualified(fresh), fs.makeQualified(name(f"{path}/{POINTER}")), how)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(name(path)) if s.getPath().getName().startswith("v-"))
    for old in versions[:-KEPT]:
        fs.delete(name(f"{path}/{old}"), True)
    return spark.read.parquet(f"{path}/{version}")

"""The search language's fields: columns, kinds, aliases. Fields are data; the compiler runs over any table that binds them."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum, auto


class Kind(StrEnum):
    """What values a field takes and what its operators mean."""

    NUMBER = auto()
    RARITY = auto()
    SUBSTRING = auto()  # free text: ":" contains
    LABEL = auto()  # short text: ":" equals
    SET = auto()  # array column
    COLOR = auto()  # bit mask
    COST = auto()  # symbol -> count
    DEVOTION = auto()
    LEGALITY = auto()  # format -> status
    DATE = auto()
    YEAR = auto()


@dataclass(frozen=True)
class Field:
    column: str
    kind: Kind
    aliases: tuple[str, ...] = ()


def _field(column: str, kind: Kind, aliases: str = "") -> Field:
    return Field(column, kind, tuple(aliases.split()))


# The language's columns and their aliases.
FIELDS = (
    _field("card_artist", Kind.SUBSTRING, "artist a"),
    _field("card_name", Kind.SUBSTRING, "name"),
    _field("oracle_text", Kind.SUBSTRING, "oracle o"),
    _field("flavor_text", Kind.SUBSTRING, "flavor ft"),
    _field("card_set_code", Kind.LABEL, "set s e"),
    _field("card_layout", Kind.LABEL, "layout"),
    _field("card_border", Kind.LABEL, "border"),
    _field("card_watermark", Kind.LABEL, "watermark wm"),
    _field("collector_number", Kind.LABEL, "number cn"),
    _field("collector_number_int", Kind.NUMBER, "number cn"),
    _field("cmc", Kind.NUMBER, "cmc mv manavalue"),
    _field("creature_power", Kind.NUMBER, "power pow"),
    _field("creature_toughness", Kind.NUMBER, "toughness tou"),
    _field("planeswalker_loyalty", Kind.NUMBER, "loyalty loy"),
    _field("edhrec_rank", Kind.NUMBER),
    _field("price_usd", Kind.NUMBER, "usd"),
    _field("price_eur", Kind.NUMBER, "eur"),
    _field("price_tix", Kind.NUMBER, "tix"),
    _field("card_rarity_int", Kind.RARITY, "rarity r"),
    _field("card_types", Kind.SET, "type types t"),
    _field("card_subtypes", Kind.SET, "subtype subtypes"),
    _field("card_keywords", Kind.SET, "keyword kw"),
    _field("card_oracle_tags", Kind.SET, "oracle_tags otag oracletag function"),
    _field("card_art_tags", Kind.SET, "art_tags art atag arttag"),
    _field("card_is_tags", Kind.SET, "is"),
    _field("card_frame_data", Kind.SET, "frame"),
    _field("card_colors", Kind.COLOR, "color colors c"),
    _field("card_color_identity", Kind.COLOR, "color_identity coloridentity id identity ci"),
    _field("produced_mana", Kind.COLOR, "produces"),
    _field("mana_cost_jsonb", Kind.COST, "mana m"),
    _field("devotion", Kind.DEVOTION, "devotion"),
    _field("card_legalities", Kind.LEGALITY, "format f legal banned restricted"),
    _field("released_at", Kind.DATE, "date"),
    _field("released_at", Kind.YEAR, "year"),
)

BY_ALIAS: dict[str, tuple[Field, ...]] = {}
for _f in FIELDS:
    for _a in _f.aliases:
        BY_ALIAS[_a] = (*BY_ALIAS.get(_a, ()), _f)

NUMERIC_ALIASES = frozenset(a for a, found in BY_ALIAS.items() if any(f.kind is Kind.NUMBER for f in found))


def numeric(alias: str) -> Field | None:
    """The number field of an alias."""
    return next((f for f in BY_ALIAS.get(alias.lower(), ()) if f.kind is Kind.NUMBER), None)


def other(alias: str) -> Field | None:
    """The field of an alias that is not a number."""
    return next((f for f in BY_ALIAS.get(alias.lower(), ()) if f.kind is not Kind.NUMBER), None)


# Names of colours, formats, rarities and types.
COLOR_NAMES = {"w": "white", "u": "blue", "b": "black", "r": "red", "g": "green", "c": "colorless"}
FORMAT_NAMES = {"m": "modern", "s": "standard", "l": "legacy", "p": "pauper", "c": "commander", "v": "vintage", "h": "historic"}
RARITIES = ("common", "uncommon", "rare", "mythic", "special", "bonus")
SUPERTYPES = ("Basic", "Legendary", "Snow", "World")
TYPES = ("Artifact", "Conspiracy", "Creature", "Enchantment", "Instant", "Kindred", "Land", "Planeswalker", "Sorcery", "Tribal")
YEARS = range(1992, 2041)

"""A query in plain words."""

from __future__ import annotations

from quarry.plans.fields import COLOR_NAMES, FORMAT_NAMES, Kind
from quarry.plans.syntax import And, Arith, Compare, Everything, ExactName, Node, Not, Number, Or, Pattern, Ref, Text

SIGNS = {"=": "is", "!=": "is not", ">=": "≥", "<=": "≤", ":": "contains", "*": "×", "/": "÷"}
# What columns are called where their name, with spaces, doesn't say it.
NAMES = {
    "cmc": "mana value", "creature_power": "power", "creature_toughness": "toughness", "card_color_identity": "color identity", "card_colors": "color",
    "card_name": "name", "card_types": "type", "card_subtypes": "subtype", "card_rarity_int": "rarity", "card_legalities": "format", "card_artist": "artist",
    "card_set_code": "set", "mana_cost_jsonb": "mana cost", "planeswalker_loyalty": "loyalty", "card_keywords": "keyword", "card_layout": "layout",
    "card_border": "border", "card_watermark": "watermark", "released_at": "release date", "price_usd": "price (USD)", "price_eur": "price (EUR)",
    "price_tix": "price (TIX)", "edhrec_rank": "EDHREC rank",
}
WITH_ARTICLE = {"creature_power", "creature_toughness", "cmc", "card_rarity_int"}
CONTAINING = {"card_name", "oracle_text", "card_types", "card_artist", "card_set_code"}


def column_name(column: str) -> str:
    return NAMES.get(column, column.replace("_", " "))


def explain(node: Node) -> str:
    """The tree in words; the empty query says nothing."""
    match node:
        case And(items):
            return " and ".join(f"({explain(i)})" if isinstance(i, Or) else explain(i) for i in items)
        case Or(items):
            return " or ".join(f"({explain(i)})" if isinstance(i, And) else explain(i) for i in items)
        case Not(item):
            return f"not ({explain(item)})" if isinstance(item, (And, Or)) else f"not {explain(item)}"
        case ExactName(text):
            return f"the name is exactly {text}"
        case Compare(op, left, right):
            return comparison(op, left, right)
        case Arith(op, left, right):
            return f"{explain(left)} {SIGNS.get(op, op)} {explain(right)}"
        case Ref(field, _):
            return column_name(field.column)
        case Number(value):
            return str(value)
        case Pattern(value):
            return f"/{value}/"
        case Text(value):
            return value
        case Everything():
            return ""
    return str(getattr(node, "value", node))


def comparison(op: str, left: Node, right: Node) -> str:
    sign = SIGNS.get(op, op)
    if not isinstance(left, Ref):
        return f"{explain(left)} {sign} {explain(right)}"
    if isinstance(right, Text) and not right.value.strip():
        return ""
    column, value = left.field.column, explain(right)
    if left.field.kind is Kind.COLOR and isinstance(right, Text) and value and set(value.lower()) <= set(COLOR_NAMES) and len(value) <= 5:
        value = "/".join(COLOR_NAMES[c].capitalize() for c in value.lower())
    if left.field.kind is Kind.LEGALITY:
        value = FORMAT_NAMES[value.lower()].capitalize() if value.lower() in FORMAT_NAMES else value
        status = left.alias if left.alias in ("banned", "restricted") else "legal"
        return f"it's {'not ' if op == '!=' else ''}{status} in {value}"
    if op in ("=", ":"):
        if column in ("card_colors", "card_color_identity"):
            return f"the {column_name(column)} is {value}"
        if column in CONTAINING:
            return f"the {column_name(column)} contains {value}"
    return f"the {column_name(column)} {sign} {value}" if column in WITH_ARTICLE else f"{column_name(column)} {sign} {value}"

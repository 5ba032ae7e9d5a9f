"""Turns a syntax tree into one Spark Column; Catalyst does the rest.

Three-valued logic: numbers, labels, artist and dates are null where missing, and a negation keeps them out. Colours, sets,
costs, devotion and legalities are never unknown: what is missing counts as empty.
"""

from __future__ import annotations

import datetime
import functools
import operator
import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.colors import mask
from quarry.functions.mana import devotion, mana_value, pips
from quarry.functions.text import fold_accents
from quarry.plans.fields import FORMAT_NAMES, RARITIES, SUPERTYPES, TYPES, Field, Kind
from quarry.plans.syntax import And, Arith, Compare, Everything, ExactName, Node, Not, Number, Or, Pattern, QueryError, Ref, Text

Bind = Callable[[str], Column]

COMPARE: dict[str, Callable[[Column, object], Column]] = {":": operator.eq, "=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
ARITH: dict[str, Callable[[Column, Column], Column]] = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": F.try_divide}
STATUS = {"banned": "banned", "restricted": "restricted"}
SHARED_TYPE = "Battle"  # filed by no type list; looked up in types and subtypes


def compile_tree(node: Node, bind: Bind | Mapping[str, Column] | None = None, gaps: bool = False) -> Column:
    """The predicate of a tree. bind gives a column of the language its Column (by default the one of that name).

    gaps: the words of a text value may stand apart in the text, in their order; else they stand as they are written."""
    return Compiler(F.col if bind is None else bind if callable(bind) else bind.__getitem__, gaps).predicate(node)


class Compiler:
    def __init__(self, bind: Bind, gaps: bool = False):
        self.bind, self.gaps = bind, gaps

    def predicate(self, node: Node) -> Column:
        match node:
            case Everything():
                return F.lit(True)
            case And(items):
                return functools.reduce(operator.and_, map(self.predicate, sorted(items, key=weight)))
            case Or(items):
                return functools.reduce(operator.or_, map(self.predicate, sorted(items, key=weight)))
            case Not(item):
                return ~self.predicate(item)
            case ExactName(text):
                return F.lower(self.bind("card_name")) == text.lower()
            case Compare(op, Ref(field, alias), right) if field.kind is not Kind.NUMBER:
                return LEAVES[field.kind](self, field, alias, op, right)
            case Compare(op, left, right):
                return COMPARE[op](self.number(left), self.number(right))
        raise QueryError("An expression of numbers alone matches nothing; compare it with something")

    def number(self, node: Node) -> Column:
        match node:
            case Number(value):
                return F.lit(value)
            case Ref(field, _) if field.kind is Kind.NUMBER:
                return self.bind(field.column)
            case Arith(op, left, right):
                return ARITH[op](self.number(left).cast("double"), self.number(right).cast("double"))
        raise QueryError("Only numbers and number fields can be calculated with or compared to a number")

    def rarity(self, field: Field, alias: str, op: str, right: Node) -> Column:
        value = plain_text(right).lower().strip()
        found = [i for i, name in enumerate(RARITIES) if value in (name, name[0])]
        if not found:
            raise QueryError(f"Unknown rarity {value!r}; known are {', '.join(RARITIES)}")
        return COMPARE[op](self.bind(field.column), F.lit(found[0]))

    def substring(self, field: Field, alias: str, op: str, right: Node) -> Column:
        column = self.bind(field.column)
        if isinstance(right, Pattern):
            return self.regex(column, right.value)
        value = plain_text(right).lower()
        if op != ":":
            return COMPARE[op](F.lower(column), F.lit(value))
        if field.column == "card_name":
            return self.holds(self.bind("card_name_folded"), fold_accents(value))
        return self.holds(F.lower(column), value)

    def holds(self, column: Column, value: str) -> Column:
        words = value.split()
        if not self.gaps or len(words) < 2:
            return F.contains(column, F.lit(value))
        return column.like("%" + "%".join(re.sub(r"([\\%_])", r"\\\1", w) for w in words) + "%")

    def regex(self, column: Column, pattern: str) -> Column:
        try:
            re.compile(pattern)
        except re.error as e:
            raise QueryError(f"Invalid regular expression {pattern!r}: {e}") from e
        return column.rlike(f"(?i){pattern}")

    def label(self, field: Field, alias: str, op: str, right: Node) -> Column:
        if isinstance(right, Pattern):
            raise QueryError(f"{alias} takes no regular expression")
        value = plain_text(right)
        return COMPARE[op](self.bind(field.column), F.lit(value if field.column == "collector_number" else value.lower()))

    def sets(self, field: Field, alias: str, op: str, right: Node) -> Column:
        if isinstance(right, Pattern):
            raise QueryError(f"{alias} takes no regular expression")
        value, column = plain_text(right).strip(), field.column
        if column in ("card_types", "card_subtypes"):
            value = value.title()
            if value == SHARED_TYPE and op in (":", ">="):
                return against(self.bind("card_types"), op, value) | against(self.bind("card_subtypes"), op, value)
            column = "card_types" if value in SUPERTYPES + TYPES else "card_subtypes"
        else:
            value = value.title() if column == "card_frame_data" else value.lower()
        return against(self.bind(column), op, value)

    def color(self, field: Field, alias: str, op: str, right: Node) -> Column:
        try:
            want = mask(plain_text(right).strip(), field.column == "produced_mana")
        except ValueError as e:
            raise QueryError(str(e)) from e
        column = self.bind(field.column)
        if op == ":":
            op = "<=" if field.column == "card_color_identity" else ">="
        # a missing mask is an empty one; written so that Parquet statistics can use it where there are few masks
        empty = column.isNull()
        if op in ("=", "!=") or op == ">=" and not want:
            same = column.eqNullSafe(want) if want else empty | (column == 0)
            return ~same if op == "!=" else same
        if op in ("<", "<="):
            within = [m for m in range(64) if not m & ~want and (op == "<=" or m != want)]
            return column.isin(within) | empty if 0 in within else F.lit(False)
        have = F.coalesce(column, F.lit(0))
        holds = have.bitwiseAND(F.lit(want)) == want
        return holds if op == ">=" else holds & (have != want)

    def cost(self, field: Field, alias: str, op: str, right: Node) -> Column:
        text = plain_text(right)
        return against_counts(self.bind(field.column), op, pips(text), F.coalesce(self.bind("cmc").cast("double"), F.lit(0.0)), mana_value(text))

    def devoted(self, field: Field, alias: str, op: str, right: Node) -> Column:
        return against_counts(self.bind(field.column), op, devotion(plain_text(right)))

    def legality(self, field: Field, alias: str, op: str, right: Node) -> Column:
        if op not in (":", "=", "!="):
            raise QueryError(f"{alias} can't be ordered")
        value = plain_text(right).strip().lower()
        status = F.try_element_at(self.bind(field.column), F.lit(FORMAT_NAMES.get(value, value)))
        met = F.coalesce(status == STATUS.get(alias, "legal"), F.lit(False))
        return ~met if op == "!=" else met

    def date(self, field: Field, alias: str, op: str, right: Node) -> Column:
        value, column = plain_text(right), self.bind(field.column)
        if len(value) > 4:
            return COMPARE[op](column, F.lit(datetime.date.fromisoformat(value)))
        # a year alone stands for a day before its first one
        first = F.lit(datetime.date(int(value), 1, 1))
        if op in ("<", "<="):
            return column < first
        if op in (">", ">="):
            return column >= first
        never = (column < first) & (column >= first)
        return ~never if op == "!=" else never

    def year(self, field: Field, alias: str, op: str, right: Node) -> Column:
        column, year = self.bind(field.column), int(plain_text(right))
        first, after = F.lit(datetime.date(year, 1, 1)), F.lit(datetime.date(year + 1, 1, 1))
        within = (column >= first) & (column < after)
        return {":": within, "=": within, "!=": ~within, "<": column < first, "<=": column < after, ">": column >= after, ">=": column >= first}[op]


LEAVES: dict[Kind, Callable[[Compiler, Field, str, str, Node], Column]] = {
    Kind.RARITY: Compiler.rarity,
    Kind.SUBSTRING: Compiler.substring,
    Kind.LABEL: Compiler.label,
    Kind.SET: Compiler.sets,
    Kind.COLOR: Compiler.color,
    Kind.COST: Compiler.cost,
    Kind.DEVOTION: Compiler.devoted,
    Kind.LEGALITY: Compiler.legality,
    Kind.DATE: Compiler.date,
    Kind.YEAR: Compiler.year,
}

#: Leaves by cost of evaluation: codegen keeps the written order, and both connectives commute.
COSTLY = {Kind.SUBSTRING: 2, Kind.COST: 1, Kind.DEVOTION: 1, Kind.SET: 1, Kind.LEGALITY: 1}


def weight(node: Node) -> int:
    match node:
        case And(items) | Or(items):
            return max(map(weight, items))
        case Not(item):
            return weight(item)
        case Compare(_, Ref(field, _), right):
            return COSTLY.get(field.kind, 0) + isinstance(right, Pattern)
    return 0


def plain_text(node: Node) -> str:
    value = getattr(node, "value", None)
    if value is None:
        raise QueryError("Expected a value")
    return str(value)


def against(column: Column, op: str, value: str) -> Column:
    """A set against the set of one value."""
    have = F.coalesce(column, F.array().cast("array<string>"))
    holds, only = F.array_contains(have, value), F.size(have) == 1
    match op:
        case ":" | ">=":
            return holds
        case "=":
            return only & holds
        case "!=":
            return ~(only & holds)
        case ">":
            return holds & (F.size(have) > 1)
        case "<=":
            return F.forall(have, lambda x: x == value)
    return F.size(have) == 0


def against_counts(column: Column, op: str, want: dict[str, int], size: Column | None = None, want_size: int = 0) -> Column:
    """Symbol counts (and a size that goes with them) against those of a query."""
    have = F.coalesce(column, F.create_map().cast("map<string,int>"))
    known = F.create_map(*[F.lit(x) for pair in want.items() for x in pair]) if want else F.create_map().cast("map<string,int>")
    each = [F.coalesce(F.try_element_at(have, F.lit(s)), F.lit(0)) >= n for s, n in want.items()]
    more = functools.reduce(operator.and_, each, F.lit(True))
    less = F.forall(F.map_entries(have), lambda e: e["value"] <= F.coalesce(F.try_element_at(known, e["key"]), F.lit(0)))
    if size is not None:
        more, less = (size >= want_size) & more, (size <= want_size) & less
    same = more & less
    return {":": more, ">=": more, "<=": less, "=": same, "!=": ~same, ">": more & ~same, "<": less & ~same}[op]

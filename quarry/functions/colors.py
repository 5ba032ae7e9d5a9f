"""Colour sets as bit masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.plans.fields import COLOR_NAMES

# A colour's bit; colorless is a value only where mana is produced.
BITS = {"W": 16, "U": 8, "B": 4, "R": 2, "G": 1, "C": 32}


def mask(value: str, colorless_is_value: bool) -> int:
    """The mask of a colour name or of colour letters. Raises ValueError."""
    value = value.lower()
    letters = next((k for k, name in COLOR_NAMES.items() if name == value), value)
    if not letters or not set(letters) <= set(COLOR_NAMES):
        raise ValueError(f"Invalid color {value!r}")
    return sum(BITS[c.upper()] for c in set(letters) if c != "c" or colorless_is_value)


def mask_column(letters: Column) -> Column:
    """array<string> of colour letters -> mask."""
    bits = F.create_map(*[F.lit(x) for pair in BITS.items() for x in pair])
    return F.aggregate(F.array_distinct(F.coalesce(letters, F.array().cast("array<string>"))), F.lit(0), lambda s, c: s + F.coalesce(F.try_element_at(bits, c), F.lit(0)))

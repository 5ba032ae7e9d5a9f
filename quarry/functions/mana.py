"""Mana costs: symbol counts, mana value and devotion, for query literals (Python) and for columns (Spark)."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

BARE = "WUBRGCX"  # symbols that may stand without braces
DEVOTION = "WUBRGC"


def _split(cost: str) -> tuple[list[str], str]:
    """Braced symbols, and what stands outside braces (a gap for each symbol)."""
    cost = cost.upper()
    return re.findall(r"\{([^}]*)\}", cost), re.sub(r"\{[^}]*\}", " ", cost)


def pips(cost: str) -> dict[str, int]:
    """Counts of the symbols that aren't numbers; hybrids are symbols of their own."""
    braced, bare = _split(cost)
    return dict(Counter([s for s in braced if not re.fullmatch(r"\s*[+-]?\d+\s*", s)] + [c for c in bare if c in BARE]))


def mana_value(cost: str) -> int:
    """Numbers count as themselves, X as nothing, any other symbol as one."""
    braced, bare = _split(cost)
    amounts = [int(s) if re.fullmatch(r"\s*[+-]?\d+\s*", s) else int(s != "X") for s in braced]
    return sum(amounts) + sum(int(s) if s.isdigit() else 1 for s in re.findall(r"\d+|[WUBRGC]", bare))


def devotion(cost: str) -> dict[str, int]:
    """Colour letters in a cost; a hybrid counts for each of its colours."""
    return {c: n for c, n in Counter(cost.upper()).items() if c in DEVOTION}


def _counted(symbols: Column) -> Column:
    """array<string> -> map<string, int> of counts."""
    return F.map_from_entries(F.transform(F.array_distinct(symbols), lambda s: F.struct(s, F.size(F.filter(symbols, lambda x: x == s)))))


def pips_column(cost: Column) -> Column:
    """pips() of a braced cost column."""
    braced = F.regexp_extract_all(F.upper(F.coalesce(cost, F.lit(""))), F.lit(r"\{([^}]*)\}"), F.lit(1))
    return _counted(F.filter(braced, lambda s: ~s.rlike(r"^\s*[+-]?\d+\s*$")))


def devotion_column(cost: Column) -> Column:
    """devotion() of a cost column."""
    return _counted(F.regexp_extract_all(F.upper(F.coalesce(cost, F.lit(""))), F.lit(f"[{DEVOTION}]"), F.lit(0)))


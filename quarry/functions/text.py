"""Text helpers that Spark has no built-in for: accent folding and title case, as plain functions and as Arrow UDFs for ingest."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_accents(text: str) -> str:
    """Text without the marks that compatibility decomposition splits off its letters."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _arrow(change: Callable[[str], str], text: Column) -> Column:
    """A text function as an Arrow UDF (made when called, since it needs a session)."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(change, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def folded(text: Column) -> Column:
    """Accent-folded text, for ingest only; queries compare with the stored column."""
    return _arrow(fold_accents, text)


def titled(text: Column) -> Column:
    """Python's title case (initcap differs after apostrophes and hyphens)."""
    return _arrow(str.title, text)


def digits_int(text: Column) -> Column:
    """The digits of a text as a 32-bit integer; null without digits or beyond the range."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("int")

"""Helpers for columns: values worked out once, and a caller's columns that have names an operator needs for itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def set_aside(docs: DataFrame, reserved: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with clashing columns renamed, and what gives a result of the same columns their names back."""
    names, taken = [], {c.lower() for c in docs.columns} | reserved
    for column in docs.columns:
        name = column
        while name.lower() in reserved or name != column and name.lower() in taken:
            name += "x"
        taken.add(name.lower())
        names.append(name)
    return docs.toDF(*names), lambda result: result.toDF(*docs.columns)

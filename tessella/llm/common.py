"""What the operators of this subpackage share: tables and lineage cuts, A-Z lower-casing, names."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import column, cut, ship, table

__all__ = ["column", "cut", "fresh", "lower_az", "narrow", "ship", "table"]


def lower_az(text: Column) -> Column:
    """Lower-cases A to Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for internal use that clash with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def narrow(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.select(*[column(c) for c in cols])

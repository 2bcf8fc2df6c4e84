"""Small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results compared across engines are rounded to this many places.
ROUND = 6


def r6(c, name: str | None = None) -> Column:
    col = F.round(F.col(c) if isinstance(c, str) else c, ROUND)
    return col.alias(name) if name else col


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def truthy_num(c) -> Column:
    """Python truthiness for numbers: 0 / 0.0 / NULL count as missing (NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != 0, c)


def truthy_str(c) -> Column:
    """Python truthiness for text: '' / NULL count as missing (NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)

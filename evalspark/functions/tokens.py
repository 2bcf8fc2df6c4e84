"""One definition of "token" for the whole library.

A token is what Python's ``str.lower().split()`` yields: text lower-cased and
split on runs of Unicode whitespace, no empty pieces.  Java's ``(?U)\\s``
includes U+00A0 and the other Unicode spaces; plain ``\\s`` does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE_WS = r"(?U)\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_ws(c) -> Column:
    """``str.split()`` without lower-casing."""
    return F.array_remove(F.split(_c(c), UNICODE_WS), "")


def tokens(c) -> Column:
    """``str.lower().split()``."""
    return split_ws(F.lower(_c(c)))


def normalize_ws(c) -> Column:
    """``' '.join(s.strip().lower().split())`` — case and whitespace normalised text."""
    return F.array_join(tokens(c), " ")


def collapse_ws(c) -> Column:
    """``' '.join(s.split())`` — whitespace collapsed, case kept."""
    return F.array_join(split_ws(c), " ")


def set_jaccard(a: Column, b: Column, both_empty: float = 1.0, one_empty: float = 0.0) -> Column:
    """|A∩B| / |A∪B| of the token *sets*; the empty cases are parameters (three conventions exist)."""
    sa, sb = F.array_distinct(a), F.array_distinct(b)
    inter = F.size(F.array_intersect(sa, sb))
    union = F.size(F.array_union(sa, sb))
    return (F.when((F.size(sa) == 0) & (F.size(sb) == 0), F.lit(both_empty))
             .when((F.size(sa) == 0) | (F.size(sb) == 0), F.lit(one_empty))
             .otherwise(inter / union))


def word_count(c) -> Column:
    return F.size(split_ws(c))

"""Measure expressions.

Facts store measures as text. Census and survey values alike are cast to
double, whatever their number of decimals, and summed as doubles; sums of
whole numbers are exact, sums of fractions may differ in the last bits with
the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_TYPE = "double"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def measure(col: Column | str, strict: bool = True) -> Column:
    """Text -> double. ``strict`` raises on bad text (ANSI cast); otherwise NULL."""
    c = _c(col)
    return c.cast("double") if strict else c.try_cast("double")


def score(col: Column | str, strict: bool = True) -> Column:
    """Text -> survey value used by every sum."""
    c = _c(col)
    return c.cast(SCORE_TYPE) if strict else c.try_cast(SCORE_TYPE)


def rejected(col: Column | str, target: str = "double") -> Column:
    """True where a non-NULL text does not cast to ``target`` (K7 reject)."""
    c = _c(col)
    return c.isNotNull() & c.try_cast(target).isNull()


def zero_fill(col: Column | str) -> Column:
    """Numeric or NULL -> double, NULL becomes 0.0 (K8)."""
    return F.coalesce(_c(col).cast("double"), F.lit(0.0))

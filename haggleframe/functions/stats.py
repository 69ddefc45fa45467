"""Order statistics of small samples as aggregate expressions on exact positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _disc(x: str, share: float, descending: bool = False) -> Column:
    """An element itself, of whole numbers."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {x}{' DESC' if descending else ''})").cast("long")


def quantile_linear(x: str, share: float) -> Column:
    """Between neighbours, position (n - 1) * share."""
    return F.percentile(x, F.lit(share))


def lower_quartile(x: str) -> Column:
    """Element at floor((n - 1) / 4)."""
    return _disc(x, 0.25)


def upper_quartile(x: str) -> Column:
    """Element at ceil(3 (n - 1) / 4), the lower quartile from above."""
    return _disc(x, 0.25, descending=True)


def integer_median(x: str) -> Column:
    """Middle element, or the mean of the two middle ones without its fraction."""
    return F.floor((_disc(x, 0.5) + _disc(x, 0.5, descending=True)) / 2).cast("long")


def upper_median(x: str) -> Column:
    """Element at n // 2."""
    return _disc(x, 0.5, descending=True)


def count_where(p: Column) -> Column:
    return F.count(F.when(p, 1))

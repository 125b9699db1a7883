"""Sums and means that do not depend on the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(column: str | Column, scale: int = 6) -> Column:
    """Sum of doubles as decimals: the same for any partitioning."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast(f"decimal(24,{scale})")).cast("double")


def exact_avg(column: str | Column, scale: int = 6) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return exact_sum(c, scale) / F.count(c)


def rounded(c: Column, places: int) -> Column:
    """A double rounded by its value in units of the last place, half up, as SQL's round does; ``F.round`` goes by its shortest digits.

    29754.6 / 480 is 61.988749999999996 in doubles, but 619887.5 in units of the fourth place.
    """
    return F.round(c * F.lit(10.0**places)) / F.lit(10.0**places)


def pct(part: Column, whole: Column, places: int = 4) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), places)


def filled(column: str | Column) -> Column:
    """Not null and not blank."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""

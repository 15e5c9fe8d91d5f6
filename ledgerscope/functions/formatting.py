"""Display formatting for KPI cards and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column) -> Column:
    """Two decimals with thousands separators; NULL shows as ``0.00``.

    Rounds the binary value as Python's ``format`` does, for magnitudes below
    1e15 (Java keeps 17 significant digits).
    """
    return F.coalesce(F.format_number(x.cast("double"), 2), F.lit("0.00"))


def integer(x: Column) -> Column:
    """Whole number (fraction truncated) with separators; NULL shows as ``0``."""
    return F.coalesce(F.format_number(x.cast("double").cast("bigint"), 0), F.lit("0"))


def long_date(d: Column) -> Column:
    """``January 05, 2024``."""
    return F.date_format(d, "MMMM dd, yyyy")


def period_label(start, end) -> Column:
    """``January 05, 2024 → January 20, 2024`` for a window's dates."""
    return F.concat(long_date(F.lit(start)), F.lit(" → "), long_date(F.lit(end)))


def card_value(value: Column, value_format: Column, prefix: Column) -> Column:
    shown = F.when(value_format == "int", integer(value)).otherwise(money(value))
    return F.concat(prefix, shown)

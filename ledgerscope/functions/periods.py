"""Reporting windows: the two bound kinds and the eight date presets.

A window is two calendar dates.  The ledger compares them in two ways, and a
single report mixes both:

* ``ts_between`` - timestamp against the dates taken as midnight, so the end
  date itself is outside (a one-day window on a timestamp is empty);
* ``day_between`` - the timestamp's calendar day against the dates, so the
  whole end day is inside.

Presets are anchored on an explicit ``as_of`` date; nothing reads the clock.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Preset names in menu order, and the first day of "All Time".
PRESETS = ("Today", "Past 7 Days", "Last 14 Days", "This Week", "Last Week",
           "Last 30 Days", "Last Month", "All Time")
ALL_TIME_START = dt.date(2022, 1, 1)


def _as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


@dataclass(frozen=True)
class Window:
    start: dt.date
    end: dt.date

    @classmethod
    def of(cls, start, end) -> "Window":
        return cls(_as_date(start), _as_date(end))

    @property
    def ts_lo(self) -> Column:
        return F.lit(self.start).cast("timestamp_ntz")

    @property
    def ts_hi(self) -> Column:
        return F.lit(self.end).cast("timestamp_ntz")

    def ts_between(self, col) -> Column:
        """``col BETWEEN start AND end`` with both dates read as midnight."""
        c = F.col(col) if isinstance(col, str) else col
        return c.between(self.ts_lo, self.ts_hi)

    def ts_between_sql(self, col: str) -> str:
        """SQL text of ``ts_between`` for expression strings."""
        return (f"({col} BETWEEN TIMESTAMP_NTZ'{self.start.isoformat()} 00:00:00' "
                f"AND TIMESTAMP_NTZ'{self.end.isoformat()} 00:00:00')")

    @property
    def _day_after_end(self) -> dt.date:
        return self.end + dt.timedelta(days=1)

    def day_between_sql(self, col: str) -> str:
        """SQL text of ``day_between`` for expression strings."""
        return (f"({col} >= TIMESTAMP_NTZ'{self.start.isoformat()} 00:00:00' "
                f"AND {col} < TIMESTAMP_NTZ'{self._day_after_end.isoformat()} 00:00:00')")

    def day_between(self, col) -> Column:
        """``DATE(col) BETWEEN start AND end``: whole days, end day included.

        Written as the equal half-open range ``start <= col < end + 1 day``
        (both at midnight) so that, unlike ``to_date(col)``, it can be pushed
        to the Parquet scan.
        """
        c = F.col(col) if isinstance(col, str) else col
        return ((c >= F.lit(self.start).cast("timestamp_ntz"))
                & (c < F.lit(self._day_after_end).cast("timestamp_ntz")))


def _first_of_month(d: dt.date, months: int) -> dt.date:
    whole = d.year * 12 + d.month - 1 + months
    return dt.date(whole // 12, whole % 12 + 1, 1)


#: Days that presets count from: as a plain date and as a Spark expression of the anchor day.
_MARKS = {
    "day": (lambda d: d, lambda c: c),
    # weeks start on Sunday here; the last one that is not after the day
    "sunday": (lambda d: d - dt.timedelta(days=(d.weekday() + 1) % 7), lambda c: F.date_sub(c, (F.weekday(c) + 1) % 7)),
    # Monday to Sunday weeks: the last Sunday before the day's own week
    "past sunday": (lambda d: d - dt.timedelta(days=d.weekday() + 1), lambda c: F.date_sub(c, F.weekday(c) + 1)),
    "month": (lambda d: _first_of_month(d, 0), lambda c: F.trunc(c, "MM")),
    "past month": (lambda d: _first_of_month(d, -1), lambda c: F.add_months(F.trunc(c, "MM"), -1)),
    "all": (lambda d: ALL_TIME_START, lambda c: F.lit(ALL_TIME_START)),
}

#: Preset -> the mark and days added that give its first day, and those that give its last.
_RULES = {
    "Today": ("day", 0, "day", 0),
    "Past 7 Days": ("day", -6, "day", 0),
    "Last 14 Days": ("day", -13, "day", 0),
    "This Week": ("sunday", 0, "day", 0),
    "Last Week": ("past sunday", -6, "past sunday", 0),
    "Last 30 Days": ("day", -29, "day", 0),
    "Last Month": ("past month", 0, "month", -1),
    "All Time": ("all", 0, "day", 0),
}


def preset_window(option: str, as_of) -> Window:
    """Dates of one preset, as plain Python (for building job parameters)."""
    if option not in _RULES:
        raise ValueError(f"unknown preset {option!r}")
    first, before, last, after = _RULES[option]
    d = _as_date(as_of)
    return Window(_MARKS[first][0](d) + dt.timedelta(days=before), _MARKS[last][0](d) + dt.timedelta(days=after))


def preset_columns(as_of: Column) -> dict[str, tuple[Column, Column]]:
    """Each preset's (start, end) as Spark date expressions of ``as_of``."""
    return {name: (F.date_add(_MARKS[first][1](as_of), before), F.date_add(_MARKS[last][1](as_of), after))
            for name, (first, before, last, after) in _RULES.items()}


def date_presets(spark: SparkSession, as_of_dates: DataFrame | None = None,
                 as_of=None) -> DataFrame:
    """Preset windows as rows ``(as_of, preset_order, preset, start_date, end_date)``.

    ``as_of_dates`` is a one-column (``as_of``) DataFrame of anchor days; each
    day yields eight rows.  Alternatively pass a single ``as_of`` date.
    """
    if as_of_dates is None:
        as_of_dates = spark.range(1).select(F.lit(_as_date(as_of)).alias("as_of"))
    cols = preset_columns(F.col("as_of"))
    entries = [F.struct(F.lit(i).alias("preset_order"), F.lit(name).alias("preset"),
                        lo.alias("start_date"), hi.alias("end_date"))
               for i, (name, (lo, hi)) in enumerate(cols.items())]
    return (as_of_dates
            .select("as_of", F.explode(F.array(*entries)).alias("p"))
            .select("as_of", "p.*"))

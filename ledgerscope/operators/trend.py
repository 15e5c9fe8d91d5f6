"""Transaction volume over time (J2) and its wide form for charting.

The trend groups by the *raw* transaction type: fee rows are not
reclassified here, and direct debits are their own series.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import reference_data as rd
from ledgerscope.functions.periods import Window
from ledgerscope.operators.ledger import PAIR, all_small, by_pair, eligible, facts, ledger, provider_ok
from ledgerscope.session import shared_dir
from ledgerscope.sources.tables import LedgerTables

def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/trend/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


GRANULARITIES = ("day", "week", "month")


def period_of(day: Column, granularity: str) -> Column:
    """The period that holds a calendar day."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}, got {granularity!r}")
    # pure date arithmetic (no session time zone is involved, unlike
    # date_trunc, which returns a zoned timestamp); weeks start on Monday
    return day if granularity == "day" else F.trunc(day, granularity)


def _period(granularity: str) -> Column:
    return period_of(F.to_date(F.col("transaction_date")), granularity).alias("period")


def _trend_rows(t: LedgerTables, window: Window) -> DataFrame:
    return (ledger(t, assets=False)
            .filter(eligible() & provider_ok() & window.ts_between("transaction_date")))


def _trend_sums(t: LedgerTables, window: Window, granularity: str) -> DataFrame:
    """``period, tx_type, ghs_amount`` rows: the ledger's own, or where its dimensions are large
    sums per pair of plan ids, taken before the joins."""
    if all_small(t):
        return _trend_rows(t, window).withColumn("period", _period(granularity))
    partial = (facts(t).filter(provider_ok() & window.ts_between("transaction_date"))
               .groupBy(*PAIR, _period(granularity), "tx_type").agg(F.sum("ghs_amount").alias("ghs_amount")))
    return by_pair(t, partial, assets=False).filter(eligible())


def transaction_trend(t: LedgerTables, window: Window, granularity: str = "month") -> DataFrame:
    """``period, tx_type, total_amount`` (first-currency sum), by period."""
    return (_trend_sums(t, window, granularity)
            .groupBy("period", "tx_type")
            .agg(F.sum("ghs_amount").cast("double").alias("total_amount"))
            .orderBy("period", "tx_type"))


def trend_pivot(t: LedgerTables, window: Window, granularity: str = "month",
                types=rd.TREND_TYPES) -> DataFrame:
    """One row per period, one amount column per type in ``types``.

    Deposits and withdrawals are renamed ``Deposits`` / ``Withdrawals`` and
    are always present; a type with no rows in a period reads 0.  Types that
    are not listed, and a missing one, add up in ``Other``, so a row's columns
    add up to the period's total.  With the value list fixed, the wide form is
    one aggregation of conditional sums (one shuffle; ``pivot`` would
    aggregate twice), and the columns do not depend on the data.
    """
    types = list(dict.fromkeys(["deposit", "withdrawal", *types]))
    listed = F.coalesce(F.col("tx_type").isin(*types), F.lit(False))
    other = F.coalesce(F.sum(F.when(~listed, F.col("ghs_amount"))).cast("double"), F.lit(0.0))
    sums = [F.coalesce(F.sum(F.when(F.col("tx_type") == v, F.col("ghs_amount"))).cast("double"),
                       F.lit(0.0)).alias(rd.TREND_RENAMES.get(v, v)) for v in types]
    return (_trend_sums(t, window, granularity)
            .groupBy("period")
            .agg(*sums, other.alias(rd.TREND_OTHER))
            .orderBy("period"))


#: Most type columns of ``trend_pivot_present``.
MOST_TYPES = 100


def trend_pivot_present(t: LedgerTables, window: Window, granularity: str = "month",
                        most: int = MOST_TYPES) -> DataFrame:
    """J3 with the types that the window's rows have: one row per period, one amount column per type.

    The trend (a row a period and type) is computed once and written; a pass over it finds the types, and a
    second spreads them.  Columns are in the types' order, with deposits and withdrawals
    named ``Deposits`` / ``Withdrawals``; a name that is taken, letter case aside, gets ``_`` after it.  Of more than ``most``
    types those with the largest absolute totals have columns, ties by name; the others and rows without a
    type add up in ``Other``, so a row's columns add up to the period's total.
    """
    long = stored(_trend_sums(t, window, granularity).groupBy("period", "tx_type").agg(F.sum("ghs_amount").alias("amount")))
    totals = (long.where("tx_type IS NOT NULL").groupBy("tx_type").agg(F.abs(F.sum("amount")).alias("total"))
              .orderBy(F.col("total").desc_nulls_last(), "tx_type").limit(most))
    types = sorted(r["tx_type"] for r in totals.collect())  # at most ``most`` names
    taken, names = {"period", rd.TREND_OTHER.lower()}, {}
    for kind in types:
        name = rd.TREND_RENAMES.get(kind, kind)
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names[kind] = name
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    sums = [zero(F.sum(F.when(F.col("tx_type") == kind, F.col("amount")))).alias(name) for kind, name in names.items()]
    rest = F.lit(True) if not types else ~F.coalesce(F.col("tx_type").isin(*types), F.lit(False))
    return (long.groupBy("period").agg(*sums, zero(F.sum(F.when(rest, F.col("amount")))).alias(rd.TREND_OTHER))
            .orderBy("period"))

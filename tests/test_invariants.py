"""Invariants from SURVEY section 5, on the sf0.01 fixture."""

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import ledger, metrics, users
from ledgerscope.plans import params as P
from ledgerscope.sources.tables import fixture_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark, SF)


def test_asset_deposit_counts_sum_to_the_filtered_ledger(t):
    total = metrics.asset_metrics(t, P.WINDOW).agg(F.sum("deposit_count")).collect()[0][0]
    direct = (ledger.base_asset(t)
              .filter(P.WINDOW.ts_between("transaction_date")
                      & (F.col("transaction_type") == "deposit"))
              .count())
    assert total == direct > 0


def test_type_lists_nest(t):
    j6 = {r[0] for r in metrics.users_by_asset_type(t, P.WINDOW).select("asset_type").collect()}
    j7 = {r[0] for r in metrics.asset_types(t, P.WINDOW).collect()}
    j4 = {r[0] for r in metrics.asset_metrics(t, P.WINDOW).select("asset_type").collect()}
    assert j6 <= j7 and (j4 - {None}) <= j7 and None not in j7
    assert j6 == j4 - {None}        # same rows behind both, NULL type aside


def test_always_twelve_age_bins(t):
    assert users.age_distribution(t, P.WINDOW, P.AS_OF).count() == 12


def test_depositors_split(t):
    g = metrics.general_metrics(t, P.WINDOW).collect()[0]
    # every new depositor has exactly one lifetime deposit instant, every
    # recurring one several: the two never overlap
    s = ledger.depositors_summary(t)
    assert s.filter("tx_days > 1").count() >= g["recurring_depositors"]
    assert g["new_depositors"] <= s.filter("tx_days = 1").count()

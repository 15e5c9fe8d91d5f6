"""Registered queries: key -> ``(spark, sf_dir) -> DataFrame``.

Every query reads the fixture ledger over ``sf_dir`` in full, with the fixed
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.operators import ledger, metrics, report, state, trend, users
from ledgerscope.plans import params as P
from ledgerscope.sources import fixtures, store
from ledgerscope.sources.tables import LedgerTables, fixture_tables

Builder = Callable[[LedgerTables], DataFrame]


def registry() -> dict[str, Builder]:
    w, as_of = P.WINDOW, P.AS_OF
    reg: dict[str, Builder] = {
        # J1, J13
        "general_metrics": lambda t: metrics.general_metrics(t, w),
        "date_presets": lambda t: metrics.general_metrics_presets(t, as_of),
        # J2, J3
        "trend_day": lambda t: trend.transaction_trend(t, w, "day"),
        "trend_week": lambda t: trend.transaction_trend(t, w, "week"),
        "trend_month": lambda t: trend.transaction_trend(t, w, "month"),
        "trend_pivot": lambda t: trend.trend_pivot(t, w, "day"),
        "trend_pivot_present": lambda t: trend.trend_pivot_present(t, w, "day"),
        # J4, J4r, J4f, J16
        "asset_metrics": lambda t: metrics.asset_metrics(t, w),
        "asset_revenue": lambda t: metrics.asset_revenue(t, w),
        "asset_fees": lambda t: metrics.asset_fees(t, w),
        "asset_detail": lambda t: metrics.asset_detail(t, w, P.SELECTED_ASSET),
        # J5, J6, J7, J7c
        "user_counts": lambda t: metrics.user_counts(t, w),
        "users_by_asset_type": lambda t: metrics.users_by_asset_type(t, w),
        "asset_types": lambda t: metrics.asset_types(t, w),
        "asset_type_count": lambda t: metrics.asset_type_count(t, w),
        # J8, J8a, J8b, J9, J10
        "user_insights": lambda t: users.user_insights(t, w),
        "active_users": lambda t: users.active_users(t, w),
        "recent_users": lambda t: users.recent_users(t, w),
        "user_kpis": lambda t: users.user_kpis(t, w),
        "user_clean": lambda t: users.user_clean(t, w, as_of),
        # J11, J12
        "dist_gender": lambda t: users.distribution(t, w, as_of, "gender"),
        "dist_country": lambda t: users.distribution(t, w, as_of, "country"),
        "dist_use_option": lambda t: users.distribution(t, w, as_of, "use_option"),
        "dist_status": lambda t: users.distribution(t, w, as_of, "status"),
        "dist_employment": lambda t: users.distribution(t, w, as_of, "employment_status"),
        "dist_age_group": lambda t: users.age_distribution(t, w, as_of),
        # J14, J15
        "kpi_general": lambda t: report.kpi_general(t, w),
        "kpi_asset": lambda t: report.kpi_asset(t, w),
        "kpi_user": lambda t: report.kpi_user(t, w),
        "report_mart": lambda t: report.report_mart(t, w, as_of),
        "mart_contents": lambda t: report.mart_contents(t, w, as_of),
        # J1, J2, J18, J19 from the state of appended batches
        "general_metrics_batches": lambda t: state.general_metrics(_state(t), t, w),
        "trend_week_batches": lambda t: state.transaction_trend(_state(t), t, w, "week"),
        "depositors_batches": lambda t: state.depositors_summary(_state(t), t),
        "first_transactions_batches": lambda t: state.first_transactions(_state(t), t),
        # J2 and J17 from the co-partitioned store
        "trend_month_stored": lambda t: store.transaction_trend(_store(t), w, "month"),
        "ledger_base_stored": lambda t: store.ledger_base(_store(t)),
        # J17-J20
        "ledger_base": lambda t: ledger.ledger_base(t),
        "depositors_summary": lambda t: ledger.depositors_summary(t),
        "depositors_by_asset": lambda t: ledger.depositors_by_asset(t),
        "first_transactions": lambda t: ledger.first_transactions(t),
        "ledger_cohorts": lambda t: ledger.ledger_cohorts(t),
    }
    return reg


def _state(t: LedgerTables) -> state.LedgerState:
    """All transactions of ``t``, appended in three batches."""
    return t.staged("batches", lambda: state.replayed(t, P.BATCH_DAYS))


def _store(t: LedgerTables) -> store.LedgerStore:
    """``t``'s ledger written as a store and opened."""
    return t.staged("store", lambda: store.open_store(t.spark, store.write_store(t, buckets=P.STORE_BUCKETS)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Builder):
        return lambda spark, sf_dir: build(fixture_tables(spark, sf_dir))
    found = {k: bind(b) for k, b in registry().items()}
    # F12 over spellings that the ledger's own users don't have
    found["birth_dates_spelled"] = lambda spark, sf_dir: users.birth_dates(
        fixtures.spark_views(spark, sf_dir)["fx_spelled"], P.AS_OF)
    return found

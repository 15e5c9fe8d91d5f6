"""Money metrics on a hand-made ledger whose results are worked out by hand.

Window 2024-01-05 .. 2024-01-20.  Users 1-6; user 5 is restricted.
Savings plans: 101 u1 savings_usd_a, 102 u2 savings_usd_b, 105 u5
restricted_only, 106 u6 savings_usd_a.  Investment plans: 201 u4 asset 1
(equity), 202 u3 asset 9 (unknown), 204 u6 asset 2 (spread_trade).
"""

import datetime as dt

import pytest

from frames import ledger_tables, tx, user
from ledgerscope.functions.periods import Window
from ledgerscope.operators import ledger, metrics, trend

W = Window.of("2024-01-05", "2024-01-20")
FEE_NOTE = '{"note": "Monthly MAINTENANCE fee deduction"}'


@pytest.fixture(scope="module")
def t(spark):
    return ledger_tables(
        spark,
        users=[user(i, restricted=(i == 5)) for i in range(1, 7)],
        plans=[(101, 1, "savings_usd_a"), (102, 2, "savings_usd_b"),
               (105, 5, "restricted_only"), (106, 6, "savings_usd_a")],
        investment_plans=[(201, 4, 1, "fixed", dt.date(2024, 6, 30)),
                          (202, 3, 9, "fixed", dt.date(2024, 6, 30)),
                          (204, 6, 2, "flexible", dt.date(2024, 6, 30))],
        assets=[(1, "equity", dt.date(2024, 12, 31)), (2, "spread_trade", dt.date(2024, 12, 31))],
        transactions=[
            tx(1, "2024-01-02 10:00:00", 100, plan_id=101),            # lifetime only
            tx(2, "2024-01-10 10:00:00", 50, plan_id=101),
            tx(3, "2024-01-06 09:00:00", 20, plan_id=102),
            tx(4, "2024-01-06 09:00:00", 30, plan_id=102),             # same instant as 3
            tx(5, "2024-01-07 00:00:00", 10, "withdrawal", plan_id=102, provider=None),
            tx(6, "2024-01-08 00:00:00", 5, "withdrawal", plan_id=102, provider="Flex Dollar"),
            tx(7, "2024-01-09 00:00:00", 7, "withdrawal", plan_id=102),
            tx(8, "2024-01-11 00:00:00", 40, plan_id=101, investment_plan_id=201),  # both ids
            tx(9, "2024-01-20 00:00:00", 10, investment_plan_id=201),  # on the upper bound
            tx(10, "2024-01-20 10:00:00", 999, investment_plan_id=201),  # end day: outside
            tx(11, "2024-01-12 00:00:00", 60, investment_plan_id=202),
            tx(12, "2024-01-13 00:00:00", 70, investment_plan_id=202),
            tx(13, "2024-01-10 00:00:00", 1000, plan_id=105),          # restricted owner
            tx(14, "2024-01-15 00:00:00", 3, "withdrawal", plan_id=106, metadata=FEE_NOTE),
            tx(15, "2024-01-16 00:00:00", 8, "early_withdrawal", plan_id=106, usd=16),
            tx(16, "2024-01-17 00:00:00", 9, "withdrawal", investment_plan_id=204),
            tx(17, "2024-01-10 00:00:00", 500, plan_id=101, status="failed"),
            tx(18, "2024-01-10 00:00:00", 5),                          # no plan at all
        ])


def test_general_metrics(t):
    r = metrics.general_metrics(t, W).collect()[0].asDict()
    assert r["deposit_count"] == 7
    assert r["deposit_value_ghs"] == 280.0 and r["deposit_value_usd"] == 560.0
    # NULL provider (5) and the excluded provider (6) are not withdrawals; the
    # fee row (14) is reclassified
    assert r["withdrawal_count"] == 2 and r["withdrawal_value_ghs"] == 16.0
    assert r["aum_ghs"] == 264.0
    assert r["total_depositors"] == 4 and r["total_withdrawers"] == 2
    # u1 (3 instants), u3 (2), u4 (2, one outside the window) recur; u2's two
    # deposits share one instant, first in the window -> new
    assert r["recurring_depositors"] == 3 and r["new_depositors"] == 1
    assert r["avg_deposit_value_ghs"] == 40.0 and r["avg_withdrawal_value_ghs"] == 8.0


def test_asset_metrics(t):
    rows = {r["asset_type"]: r.asDict() for r in metrics.asset_metrics(t, W).collect()}
    assert set(rows) == {"savings_usd_a", "equity", "savings_usd_b", None, "spread_trade"}
    a = rows["savings_usd_a"]
    assert (a["deposit_count"], a["deposit_value_ghs"], a["withdrawal_count"]) == (1, 50.0, 0)
    assert a["withdrawal_value_ghs"] is None and a["aum_ghs"] == 50.0
    assert (a["recurring_depositors"], a["new_depositors"]) == (1, 0)
    assert a["maintenance_fees_ghs"] == 3.0
    assert a["early_withdrawal_fees_usd"] == pytest.approx(0.4, abs=1e-12)
    assert a["estimated_revenue"] == pytest.approx(0.0475 / 12 * 100, rel=1e-12)
    # both plan ids: asset type from the investment plan, owner from savings
    e = rows["equity"]
    assert (e["deposit_count"], e["total_depositors"]) == (2, 2)
    assert (e["recurring_depositors"], e["new_depositors"]) == (1, 1)
    assert e["estimated_revenue"] == pytest.approx(1.0)
    b = rows["savings_usd_b"]
    assert (b["withdrawal_count"], b["aum_ghs"], b["new_depositors"]) == (1, 43.0, 1)
    assert b["estimated_revenue"] == pytest.approx(0.5)
    # unknown asset: a NULL group that never has new/recurring depositors
    n = rows[None]
    assert (n["deposit_count"], n["recurring_depositors"], n["new_depositors"]) == (2, 0, 0)
    assert n["estimated_revenue"] == 0.0
    # withdrawals only: net flow is NULL; revenue includes withdrawals
    s = rows["spread_trade"]
    assert s["deposit_count"] == 0 and s["deposit_value_ghs"] is None and s["aum_ghs"] is None
    assert s["estimated_revenue"] == pytest.approx(0.09)
    assert sum(r["deposit_count"] for r in rows.values()) == 7


def test_asset_metrics_order(t):
    order = [r["asset_type"] for r in metrics.asset_metrics(t, W).collect()]
    assert order[-1] == "spread_trade"      # NULL USD deposits last


def test_trend_uses_raw_types(t):
    rows = {(r["period"], r["tx_type"]): r["total_amount"]
            for r in trend.transaction_trend(t, W, "month").collect()}
    m = dt.date(2024, 1, 1)
    # the fee row (14) counts under its raw type 'withdrawal'
    assert rows == {(m, "deposit"): 280.0, (m, "withdrawal"): 19.0, (m, "early_withdrawal"): 8.0}


def test_trend_week_starts_monday(t):
    periods = {r["period"] for r in trend.transaction_trend(t, W, "week").collect()}
    assert all(p.weekday() == 0 for p in periods)


def test_trend_pivot_columns(t):
    df = trend.trend_pivot(t, W, "month", types=("direct_debit",))
    assert df.columns == ["period", "Deposits", "Withdrawals", "direct_debit", "Other"]
    r = df.collect()[0]
    assert (r["Deposits"], r["Withdrawals"], r["direct_debit"]) == (280.0, 19.0, 0.0)


def test_users_and_types(t):
    users = {r["asset_type"]: r["total_users"]
             for r in metrics.users_by_asset_type(t, W).collect()}
    assert users == {"savings_usd_a": 2, "equity": 2, "savings_usd_b": 1, "spread_trade": 1}
    types = [r["asset_type"] for r in metrics.asset_types(t, W).collect()]
    # no user or provider filter: the restricted user's type is listed
    assert types == ["equity", "restricted_only", "savings_usd_a", "savings_usd_b", "spread_trade"]
    assert metrics.asset_type_count(t, W).collect()[0][0] == 5
    assert metrics.asset_detail(t, W, "restricted_only").count() == 0
    d = metrics.asset_detail(t, W, "equity").collect()[0]
    assert (d["deposit_count"], d["total_users"]) == (2, 2)


def test_depositor_summaries(t):
    s = {r["customer_id"]: (r["deposit_count"], r["tx_days"])
         for r in ledger.depositors_summary(t).collect()}
    assert s == {1: (3, 3), 2: (2, 1), 3: (2, 2), 4: (2, 2)}
    a = {(r["customer_id"], r["asset_type"]): r["tx_days"]
         for r in ledger.depositors_by_asset(t).collect()}
    assert a[(1, "savings_usd_a")] == 2 and a[(1, "equity")] == 1 and a[(3, None)] == 2


def test_first_transactions_keep_null_owner(t):
    f = {r["user_id"]: r["first_transaction_date"]
         for r in ledger.first_transactions(t).collect()}
    assert None in f and f[1] == dt.datetime(2024, 1, 2, 10)


def test_one_day_window_on_timestamps_is_empty(t):
    one = Window.of("2024-01-10", "2024-01-10")
    r = metrics.general_metrics(t, one).collect()[0]
    # 2024-01-10 00:00:00 is the only instant inside; none of the eligible
    # rows is at midnight that day
    assert r["deposit_count"] == 0 and r["deposit_value_ghs"] is None
    assert r["aum_ghs"] is None


def test_ledger_cohorts(t):
    rows = {r["transaction_id"]: r for r in ledger.ledger_cohorts(t).collect()}
    r8 = rows[8]
    assert (r8["customer_id"], r8["asset_type"], r8["investment_type"]) == (1, "equity", "fixed")
    assert r8["transaction_cohort"] == "2024-01" and r8["week_number"] == 2
    assert 5 not in rows and 6 not in rows and 13 not in rows


def test_presets_match_single_windows(t):
    from ledgerscope.functions.periods import PRESETS, preset_window
    as_of = dt.date(2024, 1, 31)
    multi = {r["preset"]: r.asDict() for r in metrics.general_metrics_presets(t, as_of).collect()}
    assert set(multi) == set(PRESETS)
    for name in ("Last 30 Days", "Last 14 Days", "All Time"):
        single = metrics.general_metrics(t, preset_window(name, as_of)).collect()[0].asDict()
        got = {k: multi[name][k] for k in single}
        assert got == single, name


def test_no_python_udfs_in_plans(t):
    plan = metrics.asset_metrics(t, W)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan

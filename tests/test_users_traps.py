"""User insights on a hand-made cohort; results worked out by hand.

Window 2024-01-05 .. 2024-01-20, ages on 2024-01-31.
"""

import datetime as dt

import pytest

from frames import ledger_tables, ts, tx, user
from ledgerscope.functions.periods import Window
from ledgerscope.operators import metrics, users

W = Window.of("2024-01-05", "2024-01-20")
AS_OF = dt.date(2024, 1, 31)
KYC = '{"kyc":"KYC_Completed"}'


@pytest.fixture(scope="module")
def t(spark):
    return ledger_tables(
        spark,
        users=[
            user(1, created_at="2024-01-06 08:00:00", updated_at="2024-01-20 12:00:00",
                 recent="2024-01-20 15:00:00", metadata=KYC, gender=" Male\t",
                 country="\tCountry_1\n", dob="1990-06-15", status="KYC_verifeid",
                 use_option="Investment"),
            user(2, created_at="2024-01-07 00:00:00", updated_at="2024-01-25 00:00:00",
                 metadata=KYC, gender="non binary", country="Country_2", dob="n/a",
                 status=" kyc_verified", use_option="investments "),
            user(3, created_at="2024-01-20 10:00:00", gender="male", dob="1990-01-01"),
            user(4, restricted=True, created_at="2024-01-08 00:00:00", gender="FEMALE",
                 dob="2010-01-01", status="Pending", use_option="Savings"),
            user(5, created_at="2024-01-09 00:00:00", dob="1947-12-31"),
            user(6, created_at="2024-01-10 00:00:00", dob="2006-01-01"),
            user(7, created_at="2024-01-11 00:00:00", dob="1946-01-01"),
            user(8),
        ],
        profiles=[(1, "Employed"), (1, "Second job"), (2, "Student")],
        plans=[(107, 7, "savings_usd_a")],
        investment_plans=[(204, 4, 1, "fixed", dt.date(2024, 6, 30))],
        budgets=[(2, ts("2024-01-10 00:00:00")), (7, ts("2024-01-25 00:00:00"))],
        external_transactions=[(6, ts("2024-01-12 00:00:00"))],
        messages=[("5", ts("2024-01-12 00:00:00")), ("06", ts("2024-01-12 00:00:00")),
                  ("007", ts("2024-01-13 00:00:00"))],
        transactions=[tx(1, "2024-01-10 00:00:00", 5, investment_plan_id=204),
                      tx(2, "2024-01-10 00:00:00", 5, plan_id=107, status="failed")],
    )


def test_active_users(t):
    got = {r["user_id"] for r in users.active_users(t, W).collect()}
    assert got == {"2", "4", "5", "6", "06", "007"}


def test_user_insights_flags_and_fan_out(t):
    rows = users.user_insights(t, W).collect()
    assert sorted(r["user_id"] for r in rows) == ["1", "1", "2", "4", "5", "6", "7"]
    active = {r["user_id"] for r in rows if r["is_active"]}
    recent = {r["user_id"] for r in rows if r["is_recent"]}
    # restricted user 4 counts as active; '06' / '007' are not users 6 / 7
    assert active == {"2", "4", "5", "6"} and recent == {"1"}


def test_user_kpis_count_profile_duplicates(t):
    r = users.user_kpis(t, W).collect()[0]
    assert (r["registered_users"], r["active_users"], r["users_with_most_recent_activity"]) == (7, 4, 2)


def test_user_counts_use_whole_days(t):
    r = metrics.user_counts(t, W).collect()[0]
    # user 3 signed up during the end day: counted here, not in the cohort
    assert (r["registered_users"], r["kyc_users"]) == (7, 1)


def test_clean_labels(t):
    rows = {r["user_id"]: r for r in users.user_clean(t, W, AS_OF).collect()}
    assert rows["1"]["gender"] == "male" and rows["1"]["country"] == "Country_1"
    assert rows["1"]["status"] == "kyc_verified" and rows["1"]["use_option"] == "investments"
    assert rows["2"]["gender"] == "non-binary" and rows["2"]["status"] == "kyc_verified"
    assert rows["2"]["use_option"] == "investments" and rows["2"]["dob"] is None
    assert rows["4"]["gender"] == "female" and rows["4"]["age"] == 14
    assert rows["4"]["age_group"] is None
    assert rows["5"]["age_group"] == "[73, 78)" and rows["6"]["age_group"] == "[18, 23)"
    assert rows["7"]["age"] == 78 and rows["7"]["age_group"] is None


def test_distributions(t):
    g = {r["gender"]: r["count"] for r in users.distribution(t, W, AS_OF, "gender").collect()}
    assert g == {"male": 2, "non-binary": 1, "female": 1}
    e = [(r["employment_status"], r["count"])
         for r in users.distribution(t, W, AS_OF, "employment_status").collect()]
    assert e == [("Employed", 1), ("Second job", 1), ("Student", 1)]


def test_age_distribution_keeps_empty_bins(t):
    rows = [(r["age_group"], r["count"]) for r in users.age_distribution(t, W, AS_OF).collect()]
    assert [g for g, _ in rows] == [f"[{lo}, {lo + 5})" for lo in range(18, 78, 5)]
    counts = dict(rows)
    assert counts["[33, 38)"] == 2 and counts["[73, 78)"] == 1 and counts["[18, 23)"] == 1
    assert sum(counts.values()) == 4


def test_age_bins_match_left_closed_rule(spark):
    from pyspark.sql import functions as F

    from ledgerscope.functions import text
    df = spark.range(0, 121).select(F.col("id").cast("int").alias("age"))
    got = {r["age"]: r["g"] for r in df.select("age", text.age_group_label(F.col("age")).alias("g")).collect()}
    for age in range(0, 121):
        if 18 <= age < 78:
            lo = 18 + (age - 18) // 5 * 5
            assert got[age] == f"[{lo}, {lo + 5})"
        else:
            assert got[age] is None

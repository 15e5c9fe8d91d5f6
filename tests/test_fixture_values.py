"""Values published in FIXTURES.md, at every scale factor.

The oracle shares the fixture view text with Spark, so a transcription error
in a view would not show up there; these independently published numbers
would catch it.
"""

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import metrics, users
from ledgerscope.plans import params as P
from ledgerscope.sources.tables import fixture_tables

# FIXTURES.md "Values to expect" and "What the fixtures exercise".
EXPECTED = {
    "sf0.001": dict(dep_n=250, dep_sum=11913.13, wd_n=84, wd_sum=4618.89, depositors=51,
                recurring=44, new=9, j8_rows=38, j8_users=36, active=36, recent=13,
                failed=201, null_provider=77, excluded_provider=77, fee_text=28, no_plan=25,
                restricted=14, null_created=95, two_profiles=7, no_profile=0, bad_dob=9,
                null_dob=7, null_type=19, unlisted_type=16),
    "sf0.01": dict(dep_n=2181, dep_sum=108942.89, wd_n=701, wd_sum=32245.32, depositors=529,
                recurring=451, new=92, j8_rows=299, j8_users=289, active=270, recent=90,
                failed=2014, null_provider=769, excluded_provider=770, fee_text=271,
                no_plan=244, restricted=137, null_created=928, two_profiles=66,
                no_profile=0, bad_dob=89, null_dob=74, null_type=189, unlisted_type=166),
    "sf0.1": dict(dep_n=22264, dep_sum=1109679.3, wd_n=7107, wd_sum=351107.71,
                depositors=5309, recurring=4605, new=857, j8_rows=2888, j8_users=2758,
                active=2592, recent=785, failed=19810, null_provider=7692,
                excluded_provider=7693, fee_text=2703, no_plan=2440, restricted=1364,
                null_created=9505, two_profiles=653, no_profile=0, bad_dob=883,
                null_dob=743, null_type=1887, unlisted_type=1663),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_published_values(spark, sf):
    e = EXPECTED[sf]
    t = fixture_tables(spark, f"/root/testdata/{sf}")
    g = metrics.general_metrics(t, P.WINDOW).collect()[0]
    assert (g["deposit_count"], g["withdrawal_count"]) == (e["dep_n"], e["wd_n"])
    assert g["deposit_value_ghs"] == pytest.approx(e["dep_sum"], abs=0.005)
    assert g["withdrawal_value_ghs"] == pytest.approx(e["wd_sum"], abs=0.005)
    assert g["total_depositors"] == e["depositors"]
    assert (g["recurring_depositors"], g["new_depositors"]) == (e["recurring"], e["new"])

    ins = users.user_insights(t, P.WINDOW)
    assert ins.count() == e["j8_rows"]
    assert ins.select("user_id").distinct().count() == e["j8_users"]
    k = users.user_kpis(t, P.WINDOW).collect()[0]
    assert (k["active_users"], k["users_with_most_recent_activity"]) == (e["active"], e["recent"])

    tx = t.transactions.agg(
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("provider_number").isNull()).alias("null_provider"),
        F.count_if(F.col("provider_number") == "Flex Dollar").alias("excluded_provider"),
        F.count_if(F.col("metadata").ilike("%monthly maintenance fee deduction%")).alias("fee_text"),
        F.count_if(F.col("plan_id").isNull() & F.col("investment_plan_id").isNull()).alias("no_plan"),
        F.count_if(F.col("tx_type").isNull()).alias("null_type"),
        F.count_if(F.col("tx_type") == "refund").alias("unlisted_type"),
    ).collect()[0]
    for name in ("failed", "null_provider", "excluded_provider", "fee_text", "no_plan", "null_type", "unlisted_type"):
        assert tx[name] == e[name], name
    u = t.users.agg(
        F.count_if("restricted").alias("restricted"),
        F.count_if(F.col("created_at").isNull()).alias("null_created"),
        F.count_if(F.col("dob").isNotNull() & F.col("dob").try_cast("date").isNull()).alias("bad_dob"),
        F.count_if(F.col("dob").isNull()).alias("null_dob"),
    ).collect()[0]
    for name in ("restricted", "null_created", "bad_dob", "null_dob"):
        assert u[name] == e[name], name
    per_user = t.profiles.groupBy("user_id").count()
    assert per_user.filter("count = 2").count() == e["two_profiles"]
    assert t.users.join(t.profiles, t.users.id == t.profiles.user_id, "left_anti").count() == e["no_profile"]

"""The cohort's activity is filtered in each of the five scans, before any shuffle; memberships lose no key."""

import pytest
from frames import ledger_tables, tx, user
from pyspark.sql import functions as F

from ledgerscope.functions.periods import Window
from ledgerscope.operators import membership, users
from ledgerscope.plans import params as P
from ledgerscope.sources.tables import fixture_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("ledgerscope.broadcast.maxRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("ledgerscope.broadcast.maxRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("keys, bits", [(0, 1 << 13), (1000, 1 << 14), (10**9, membership.MOST_BITS)])
def test_filter_sizes(keys, bits):
    assert membership.bits_for(keys) == bits


def test_no_key_is_lost_and_few_others_pass(spark):
    own = spark.range(0, 20_000, 4).select(F.col("id").cast("string").alias("k")).union(spark.createDataFrame([(None,)], "k string"))
    bits = membership.bits_for(5000)
    words = membership.bloom(own, "k", bits)
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"), "id").union(spark.sql("select null, -1"))
    kept = [r["id"] for r in rows.where(membership.may_hold(words, F.col("k"), bits)).collect()]
    assert {i for i in range(0, 20_000, 4)} <= set(kept) and -1 not in kept
    assert len(kept) < 5000 + 0.05 * 15_000
    full = membership.bloom(spark.range(100_000), "id", 1 << 13)  # more keys than it serves: passes everything
    assert spark.range(1000).where(membership.may_hold(full, F.col("id"), 1 << 13)).count() == 1000
    none = membership.bloom(own.where("false"), "k", bits)
    assert rows.where(membership.may_hold(none, F.col("k"), bits)).count() == 0


def test_every_scan_is_filtered_before_the_first_exchange(spark, no_broadcast):
    t = fixture_tables(spark, SF)
    lines = users._user_insights(t, P.WINDOW)._jdf.queryExecution().executedPlan().toString().splitlines()
    text = "\n".join(lines)
    main = text.split("Subquery")[0]
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*()0123456789"))
    scans = [i for i, x in enumerate(lines) if "events.parquet" in x]
    filtered = 0
    for at in scans:
        level = depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) >= level:
                continue
            level = depth(line)
            if "Exchange" in line:
                break
            if "shiftrightunsigned" in line:
                filtered += 1
                break
    assert main and filtered >= 4  # three activity tables and the transactions


def test_a_computed_id_is_read_once_by_its_filter(spark, no_broadcast):
    t = fixture_tables(spark, SF)  # the ids are computed by a rule with seven branches
    for df in (users._user_insights(t, P.WINDOW), users._user_clean(t, P.WINDOW, P.AS_OF)):
        tests = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "shiftrightunsigned" in x]
        assert tests and not [x for x in tests if "FLOOR" in x]


def test_both_paths_give_the_same(spark, no_broadcast):
    t = fixture_tables(spark, SF)
    large = sorted(map(repr, users._user_insights(t, P.WINDOW).collect()))
    pairs = sorted(map(repr, users._active_users(t, P.WINDOW).collect()))
    spark.conf.unset("ledgerscope.broadcast.maxRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(repr, users._user_insights(t, P.WINDOW).collect())) == large
    assert sorted(map(repr, users._active_users(t, P.WINDOW).collect())) == pairs


def test_owner_of_either_plan_counts(spark, no_broadcast):
    w = Window.of("2024-01-01", "2024-02-01")
    t = ledger_tables(spark, users=[user(i, created_at="2024-01-05" if i < 4 else "2023-01-05") for i in range(1, 6)],
                      plans=[(1, 1, "s"), (2, 5, "s")], investment_plans=[(11, 2, None, "f", None), (12, 4, None, "f", None)],
                      transactions=[tx(1, "2024-01-09", 1, plan_id=2, investment_plan_id=11), tx(2, "2024-01-09", 1, plan_id=1),
                                    tx(3, "2024-01-09", 1, investment_plan_id=12), tx(4, "2023-01-09", 1, plan_id=1)])
    got = {r["user_id"]: r["is_active"] for r in users.user_insights(t, w).collect()}
    assert got == {"1": True, "2": True, "3": False}
    assert {r["user_id"] for r in users.active_users(t, w).collect()} == {"1", "2", "4", "5"}

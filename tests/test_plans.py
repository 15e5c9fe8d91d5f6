"""Plan properties that the scale design relies on, and the Parquet source."""

import pytest

import __spark_entry__ as E
from ledgerscope.operators import metrics, users
from ledgerscope.plans import catalog
from ledgerscope.plans import params as P
from ledgerscope.sources.tables import SOURCE_NAMES, fixture_tables, parquet_tables

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("ledgerscope.broadcast.maxRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("ledgerscope.broadcast.maxRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_key_salt_is_a_shuffle_key(spark, no_broadcast):
    df = E.queries()["general_metrics"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "hashpartitioning(investment_plan_id" in x]
    assert lines and "_nk" in lines[0]


@pytest.mark.parametrize("key", ["general_metrics", "asset_metrics", "trend_month", "trend_pivot", "users_by_asset_type",
                                 "asset_types", "date_presets", "first_transactions", "active_users", "depositors_summary",
                                 "depositors_by_asset"])
def test_facts_are_aggregated_by_plan_pair_before_the_joins(spark, no_broadcast, key):
    """The first exchange above the fact's scan carries partial aggregates."""
    plan = E.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [i for i, x in enumerate(plan) if "events.parquet" in x]
    # the first scan is the fact's, but for the activity of users, where it is one of four
    found = [_first_aggregate(plan, at) for at in (scans if key == "active_users" else scans[:1])]
    assert any("plan_id" in line for line in found)


def _first_aggregate(plan: list[str], at: int) -> str:
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    level = depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) >= level:
            continue
        level = depth(line)
        if "Exchange" in line:
            raise AssertionError(f"raw rows are shuffled: {line}")
        if "HashAggregate" in line:
            return line
    raise AssertionError("no aggregate above the scan")


def test_presets_do_not_multiply_ledger_rows(spark):
    plan = E.queries()["date_presets"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_small_dimensions_are_broadcast(spark):
    plan = _plan(E.queries()["general_metrics"](spark, SF))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_two_level_plan_has_no_expand_or_self_join(spark):
    plan = _plan(E.queries()["general_metrics"](spark, SF))
    assert "Expand" not in plan
    # one scan of the ledger's source (events) for the whole job
    assert plan.count("events.parquet") == 1


def test_window_filter_reaches_the_scan(spark):
    for key in ("users_by_asset_type", "trend_month", "asset_types"):
        plan = _plan(E.queries()[key](spark, SF))
        scan = [x for x in plan.splitlines() if "events.parquet" in x][0]
        assert "PushedFilters" in scan and "ts" in scan.split("PushedFilters")[1], key


def test_no_python_evaluation_anywhere(spark):
    for key, build in catalog.queries().items():
        if key == "report_mart":
            continue
        plan = build(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "PythonUDF" not in plan, key


def test_parquet_source_round_trip(spark, tmp_path):
    t = fixture_tables(spark, SF)
    root = str(tmp_path / "ledger")
    for logical, name in SOURCE_NAMES.items():
        df = getattr(t, logical)
        if logical == "messages":
            df = df.withColumnRenamed("user_ref", "user")      # the source's column name
        df.write.parquet(f"{root}/{name}")
    p = parquet_tables(spark, root, fees=t.fees)
    assert "user_ref" in p.messages.columns
    for fn in (metrics.general_metrics, metrics.asset_metrics, metrics.user_counts,
               users.recent_users, users.user_insights):
        a = sorted(map(tuple, fn(t, P.WINDOW).collect()), key=repr)
        b = sorted(map(tuple, fn(p, P.WINDOW).collect()), key=repr)
        assert a == b
    # whole-day bounds are ranges on the raw column, so they reach the scan
    for df, col in ((users.recent_users(p, P.WINDOW), "most_recent_activity"),
                    (metrics.user_counts(p, P.WINDOW), "created_at")):
        plan = _plan(df)
        scan = [x for x in plan.splitlines()
                if "FileScan" in x and f"{col}:timestamp_ntz" in x][0]
        assert f"GreaterThanOrEqual({col}," in scan.split("PushedFilters")[1]


def test_partial_aggregation_before_the_customer_shuffle(spark):
    """Map-side combine: a customer with a third of all rows sends one
    partial row per task through the shuffle."""
    plan = _plan(E.queries()["general_metrics"](spark, SF)).splitlines()
    at = [i for i, x in enumerate(plan) if "Exchange hashpartitioning(customer_id" in x]
    assert at
    child = plan[at[0] + 1]
    assert "HashAggregate" in child and "partial_" in child

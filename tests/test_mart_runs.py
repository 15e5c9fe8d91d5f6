"""Report mart runs, fee schedules, stored bounds and size checks of sources."""

import dataclasses

import pytest
from frames import ledger_tables, tx, user
from pyspark.sql import functions as F

from ledgerscope import reference_data as rd
from ledgerscope.functions.periods import Window
from ledgerscope.operators import metrics, report
from ledgerscope.operators.joins import row_count_at_most
from ledgerscope.plans import catalog
from ledgerscope.sources.tables import jdbc_tables, parquet_tables

W = Window.of("2024-01-01", "2024-02-01")


def small(spark, restricted=False):
    return ledger_tables(
        spark, transactions=[tx(1, "2024-01-03", 10, plan_id=1), tx(2, "2024-01-09", 4, "withdrawal", plan_id=1)],
        users=[user(1, restricted=restricted)], plans=[(1, 1, "savings_usd_a")])


def test_two_inputs_built_before_either_is_read(spark):
    build = catalog.queries()["report_mart"]
    one, two = build(spark, "/root/testdata/sf0.001"), build(spark, "/root/testdata/sf0.01")
    again = build(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one) == rows(again) != rows(two)


def test_a_source_without_fees_is_refused(spark, tmp_path):
    t = dataclasses.replace(small(spark), fees=None)
    with pytest.raises(ValueError, match="fee"):
        metrics.asset_metrics(t, W)
    own = spark.createDataFrame([("savings_usd_a", 0.5, "ghs", True)], rd.FEE_SCHEMA)
    assert metrics.asset_metrics(t, W, own).first()["estimated_revenue"] == pytest.approx(7.0)
    report.write_report_mart(t, W, W.end, str(tmp_path / "m"), fees=own)
    stored = report.read_report_mart(spark, str(tmp_path / "m"), "asset_metrics", W).first()
    assert stored["estimated_revenue"] == pytest.approx(7.0)


def test_stored_bounds_are_reused_and_refused_when_stale(spark, tmp_path):
    root, t = str(tmp_path / "b"), small(spark)
    assert report.read_deposit_bounds(t, root) is None
    report.write_deposit_bounds(t, root)
    general, _ = report.read_deposit_bounds(t, root)
    assert general.count() == 1
    plan = metrics.general_metrics(t, W, bounds=general)._jdf.queryExecution().executedPlan().toString()
    assert "first_dep" in plan
    with pytest.raises(ValueError, match="stale"):
        report.read_deposit_bounds(small(spark, restricted=True), root)


def test_batch_job_needs_fees_for_tables(tmp_path):
    from ledgerscope.__main__ import main
    with pytest.raises(SystemExit):
        main(["--tables", str(tmp_path), "--preset", "Today", "--local"])


def test_fact_table_needs_a_partitioning(spark):
    with pytest.raises(ValueError, match="transactions"):
        jdbc_tables(spark, "jdbc:none", {})


def test_size_probe_moves_one_row_a_task(spark):
    df = spark.range(100, numPartitions=7).filter("id % 3 = 0")
    assert row_count_at_most(df, 34) and not row_count_at_most(df, 33)
    plan = df.groupBy().count()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Limit" not in plan


def test_broadcasts_of_a_job_are_bounded_together(spark):
    t = small(spark)
    try:
        assert all(t.is_small(n) for n in ("assets", "plans", "investment_plans", "users"))
        spark.conf.set("ledgerscope.broadcast.maxBytes", "60")
        assert t.is_small("assets") and t.is_small("plans") and not t.is_small("users")
        spark.conf.set("ledgerscope.broadcast.maxBytes", "0")
        assert not t.is_small("plans")
        assert metrics.general_metrics(t, W).first()["deposit_count"] == 1
    finally:
        spark.conf.unset("ledgerscope.broadcast.maxBytes")


def test_parquet_source_keeps_its_fees(spark, tmp_path):
    from ledgerscope.sources.tables import SOURCE_NAMES
    t = small(spark)
    for logical, name in SOURCE_NAMES.items():
        getattr(t, logical).write.parquet(f"{tmp_path}/{name}")
    p = parquet_tables(spark, str(tmp_path), fees=t.fees)
    assert metrics.asset_revenue(p, W).select(F.max("estimated_revenue")).first()[0] > 0

"""Stored lifetime deposit bounds: window-only jobs equal the full-history
ones, and bounds merge by min / max."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerscope.functions.periods import Window
from ledgerscope.operators import ledger, metrics, report
from ledgerscope.plans import params as P
from ledgerscope.sources.tables import fixture_tables

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bounds_paths_equal_full_history(spark, tmp_path):
    t = fixture_tables(spark, SF)
    root = str(tmp_path / "bounds")
    gen, ast = report.write_deposit_bounds(t, root)
    for w in (P.WINDOW, Window.of("2024-01-01", "2024-01-31"), Window.of("2024-01-10", "2024-01-10")):
        assert _rows(metrics.general_metrics(t, w)) == _rows(metrics.general_metrics(t, w, bounds=gen))
        assert _rows(metrics.asset_metrics(t, w)) == _rows(metrics.asset_metrics(t, w, bounds=ast))
    assert (_rows(metrics.general_metrics_presets(t, P.AS_OF))
            == _rows(metrics.general_metrics_presets(t, P.AS_OF, bounds=gen)))


def test_window_only_scan_with_bounds(spark, tmp_path):
    t = fixture_tables(spark, SF)
    gen, _ = report.write_deposit_bounds(t, str(tmp_path / "b"))
    df = metrics.general_metrics(t, P.WINDOW, bounds=gen)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.splitlines() if "events.parquet" in x][0]
    assert "PushedFilters" in scan and "ts" in scan.split("PushedFilters")[1]


def test_bounds_merge(spark):
    t = fixture_tables(spark, SF)
    rows = ledger.base_general(t)
    cut = F.col("transaction_date") < F.lit(dt.datetime(2024, 1, 15))
    keys = ["customer_id"]
    types = ("deposit", "direct_debit")
    old = ledger.deposit_bounds(rows.filter(cut), keys, types)
    new = ledger.deposit_bounds(rows.filter(~cut), keys, types)
    merged = ledger.merge_deposit_bounds(old, new, keys)
    assert _rows(merged) == _rows(ledger.general_deposit_bounds(t))

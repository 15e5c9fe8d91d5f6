"""KPI cards, the report mart, and the published fixture values (FIXTURES.md)."""

import pytest

from ledgerscope import reference_data as rd
from ledgerscope.functions.periods import Window
from ledgerscope.operators import metrics, report, users
from ledgerscope.plans import params as P
from ledgerscope.sources.tables import fixture_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark, SF)


def test_fixture_values_sf0001(t):
    r = metrics.general_metrics(t, P.WINDOW).collect()[0]
    assert (r["deposit_count"], r["withdrawal_count"]) == (250, 84)
    assert r["deposit_value_ghs"] == pytest.approx(11913.13)
    assert r["withdrawal_value_ghs"] == pytest.approx(4618.89)
    assert r["total_depositors"] == 51
    assert (r["recurring_depositors"], r["new_depositors"]) == (44, 9)
    ins = users.user_insights(t, P.WINDOW)
    assert ins.count() == 38 and ins.select("user_id").distinct().count() == 36
    k = users.user_kpis(t, P.WINDOW).collect()[0]
    assert (k["active_users"], k["users_with_most_recent_activity"]) == (36, 13)


def test_kpi_general_cards(t):
    rows = report.kpi_general(t, P.WINDOW).collect()
    assert [r["label"] for r in rows] == [c[1] for c in rd.GENERAL_CARDS]
    by = {r["metric"]: r for r in rows}
    assert by["deposit_value_ghs"]["display_value"] == "₵11,913.13"
    assert by["deposit_count"]["display_value"] == "250"
    assert by["deposit_value_usd"]["display_value"].startswith("$")
    assert by["kyc_users"]["explanation"] == rd.METRIC_EXPLANATIONS["kyc_users"]


def test_kpi_asset_cards(t):
    df = report.kpi_asset(t, P.WINDOW)
    cards = df.filter("asset_type = 'equity'").collect()
    assert [r["card_order"] for r in cards] == list(range(1, 18))
    assert cards[-1]["metric"] == "total_users"
    aum = [r for r in cards if r["metric"] == "aum_ghs"][0]
    assert not aum["display_value"].startswith(("₵", "$"))


def test_report_mart_is_idempotent_per_window(t, tmp_path):
    root = str(tmp_path / "mart")
    w2 = Window.of("2024-01-10", "2024-01-25")
    first = {r["table_name"]: r["row_count"]
             for r in report.report_mart(t, P.WINDOW, P.AS_OF, root).collect()}
    report.report_mart(t, w2, P.AS_OF, root).collect()
    again = {r["table_name"]: r["row_count"]
             for r in report.report_mart(t, P.WINDOW, P.AS_OF, root).collect()}
    assert first == again and set(first) == set(report.MART_TABLES)
    assert first["general_metrics"] == 1
    both = t.spark.read.parquet(f"{root}/general_metrics")
    assert both.count() == 2      # one row per window, the rerun replaced its own
    back = report.read_report_mart(t.spark, root, "asset_metrics", P.WINDOW)
    assert back.count() == metrics.asset_metrics(t, P.WINDOW).count()
    # the user page derived from the stored J10 equals the direct jobs
    for name, col in (("dist_gender", "gender"), ("dist_employment", "employment_status")):
        stored = {tuple(r) for r in report.read_report_mart(t.spark, root, name, P.WINDOW)
                  .select(col, "count").collect()}
        direct = {tuple(r) for r in users.distribution(t, P.WINDOW, P.AS_OF, col).collect()}
        assert stored == direct
    ages = [tuple(r) for r in report.read_report_mart(t.spark, root, "dist_age_group", P.WINDOW)
            .select("age_group", "count").collect()]
    assert sorted(ages) == sorted(tuple(r) for r in users.age_distribution(t, P.WINDOW, P.AS_OF).collect())
    assert first["user_kpis"] == 1 and first["dist_age_group"] == 12


def test_batch_job_writes_the_mart(spark, tmp_path, capsys):
    from ledgerscope.__main__ import main
    out, bounds = str(tmp_path / "mart"), str(tmp_path / "bounds")
    main(["--fixture", SF, "--preset", "Last 30 Days", "--as-of", "2024-01-31",
          "--out", out, "--bounds", bounds, "--local"])
    printed = capsys.readouterr().out
    assert all(name in printed for name in report.MART_TABLES)
    stored = report.read_report_mart(spark, out, "general_metrics",
                                     Window.of("2024-01-02", "2024-01-31"))
    direct = metrics.general_metrics(fixture_tables(spark, SF), Window.of("2024-01-02", "2024-01-31"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, direct.collect()))

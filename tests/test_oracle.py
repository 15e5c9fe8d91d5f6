"""Every registered query equals its DuckDB oracle on the sf0.001 fixture,
on both join paths (broadcast dimensions, and salted sort-merge joins)."""

import pytest

import __spark_entry__ as E
from ledgerscope.plans import oracle
from ledgerscope.plans.verify import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
KEYS = sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    ok, msg, _ = compare(df, con, E.oracle_sql()[key])
    assert ok, msg


@pytest.mark.parametrize("key", ["general_metrics", "asset_metrics", "user_insights",
                                 "ledger_cohorts", "first_transactions"])
def test_matches_oracle_without_broadcast(spark, con, key):
    spark.conf.set("ledgerscope.broadcast.maxRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = E.queries()[key](spark, SF)
        ok, msg, _ = compare(df, con, E.oracle_sql()[key])
    finally:
        spark.conf.unset("ledgerscope.broadcast.maxRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ok, msg


def test_every_query_has_an_oracle_or_is_rows_only():
    from ledgerscope.plans import catalog
    assert set(catalog.queries()) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert "deposit_count" in df.columns

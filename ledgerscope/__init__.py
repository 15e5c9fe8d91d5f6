"""ledgerscope: savings/investment ledger analytics as Spark DataFrame jobs.

Layout
------
sources/    table registry: fixture views, Parquet and JDBC readers
functions/  column expressions: window bounds and presets, text clean-up,
            age bins, number formatting
operators/  the jobs: ledger staging, platform and per-asset metrics, trends,
            user insights, KPI cards and the report mart
plans/      query catalogue (key -> builder) and the DuckDB oracle SQL
streaming/  nothing: the analytics are batch queries over closed windows
"""

from ledgerscope.session import build_session, shared_dir  # noqa: F401

__all__ = ["build_session", "shared_dir"]

"""Batch job: write the report mart for one window.

    spark-submit --py-files ledgerscope.zip -m ledgerscope \\
        --tables s3a://bucket/ledger --fees s3a://bucket/fees.parquet \\
        --preset "Last 30 Days" --as-of 2024-01-31

Reads the ledger (one Parquet folder per table) and its fee schedule
(``asset_type, rate, money, include_withdrawals``), reuses the stored lifetime
deposit bounds in ``--bounds`` (built when missing or with ``--refresh-bounds``,
refused when stale), and writes the window's report tables under ``--out``
(default: ``<spark.checkpoint.dir>/report_mart``), replacing only that window's
partitions.  Prints the mart's manifest.

With ``--results`` the mart is looked up in that folder first and computed only if no run over the
same files and arguments has stored it there (``operators.results``).
"""

from __future__ import annotations

import argparse
import datetime as dt

from ledgerscope.functions.periods import PRESETS, Window, preset_window
from ledgerscope.operators import report
from ledgerscope.operators.results import ResultStore
from ledgerscope.session import build_session, shared_dir
from ledgerscope.sources.tables import fixture_tables, parquet_tables


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="ledgerscope")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="root folder with one Parquet folder per ledger table")
    src.add_argument("--fixture", help="driver test-data folder (sfN) to build the fixture ledger from")
    ap.add_argument("--preset", choices=PRESETS)
    ap.add_argument("--start")
    ap.add_argument("--end")
    ap.add_argument("--as-of", default=None, help="anchor day for presets and ages (default: today)")
    ap.add_argument("--out", default=None)
    ap.add_argument("--fees", default=None, help="Parquet fee schedule; required with --tables")
    ap.add_argument("--bounds", default=None,
                    help="folder of the stored lifetime deposit bounds; built when missing")
    ap.add_argument("--results", default=None,
                    help="folder of stored results: reuse the mart of an earlier run over the same files")
    ap.add_argument("--refresh-bounds", action="store_true", help="build the bounds again")
    ap.add_argument("--local", action="store_true", help="run on local[*] instead of the cluster")
    args = ap.parse_args(argv)

    if args.tables and not args.fees:
        ap.error("--tables needs --fees")
    if args.results and (args.out or args.bounds):
        ap.error("--results goes without --out and --bounds")
    as_of = dt.date.fromisoformat(args.as_of) if args.as_of else dt.date.today()
    if args.preset:
        window = preset_window(args.preset, as_of)
    elif args.start and args.end:
        window = Window.of(args.start, args.end)
    else:
        ap.error("give --preset or both --start and --end")

    spark = build_session("local[*]" if args.local else None, cluster=not args.local)
    if args.tables:
        t = parquet_tables(spark, args.tables, fees=spark.read.parquet(args.fees))
    else:
        t = fixture_tables(spark, args.fixture)
    if args.results:
        store = ResultStore(spark, args.results)
        before = len(store.entries())
        for name, df in report.mart_tables(t, window, as_of, store).items():
            print(f"{name:22s} {window.start} .. {window.end} {df.count()} rows")
        print(f"results: {store.root} ({'computed' if len(store.entries()) > before else 'reused'})")
        return
    bounds = None
    if args.bounds:
        bounds = None if args.refresh_bounds else report.read_deposit_bounds(t, args.bounds)
        bounds = bounds or report.write_deposit_bounds(t, args.bounds)
    root = args.out or f"{shared_dir(spark)}/report_mart"
    for row in report.report_mart(t, window, as_of, root, bounds).collect():   # one row per table
        print(f"{row['table_name']:22s} {row['window_start']} .. {row['window_end']} "
              f"{row['row_count']} rows")
    print(f"mart: {root}")


if __name__ == "__main__":
    main()

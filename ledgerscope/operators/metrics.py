"""Money metrics: platform totals (J1), per-asset totals with revenue and fees
(J4), users per asset type (J6), asset types (J7), user counts (J5) and the
single-asset drill-down (J16).

Two-level aggregation
---------------------
"New" and "recurring" depositors compare a customer's *lifetime* deposit
history with the *window*.  Instead of a lifetime summary joined back to the
windowed rows (a self-join plus several DISTINCT aggregates), one pass groups
the full ledger by customer (J1) or by customer and asset type (J4) and keeps,
per group, the window's counts and sums and the lifetime first and last
deposit instants.  "More than one distinct deposit instant" is exactly
"first < last", and "exactly one" is "first = last", so no DISTINCT is
needed anywhere: every aggregate is a min/max/count/sum that Spark combines
map-side before the shuffle, which also absorbs a customer holding a large
share of all rows.  The second level aggregates the groups that have rows in
the window.  Averages are carried as sum and non-null count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import reference_data as rd
from ledgerscope.functions.periods import PRESETS, Window, preset_window
from ledgerscope.operators.ledger import (PAIR, all_small, base_asset, base_general, by_pair, eligible, facts,
                                          ledger, provider_ok)
from ledgerscope.operators.joins import broadcast_row_limit, row_count_at_most
from ledgerscope.sources.tables import LedgerTables

_MONEY = (("ghs", "ghs_amount"), ("usd", "usd_amount"))


def customer_rollup(rows: DataFrame, keys: list[str], windows: dict[str, Window],
                    is_deposit: Column, is_withdrawal: Column,
                    extra: list[str] = (), bounds: DataFrame | None = None,
                    resolved=None) -> DataFrame:
    """Level 1: one row per ``keys`` group.

    With ``resolved`` the rows are bare facts: they are aggregated per pair of
    plan ids, ``resolved`` joins the partials to their owners, and partials
    are merged per ``keys`` group (counts and sums add, first and last are
    min and max).

    ``windows`` maps a column suffix to a window; each window gets its own
    set of counts and sums, all from the same single pass over the rows.
    ``extra`` holds more aggregate expressions (SQL text) over the same rows;
    they may use the flags ``_dep``, ``_wd`` and ``_win{suffix}``.

    Without ``bounds`` the pass covers the full history and also yields the
    lifetime ``first_dep`` / ``last_dep``.  With ``bounds`` (a stored
    ``ledger.deposit_bounds`` table for the same rows and keys) only window
    rows are read - the date filter reaches the scan - and the lifetime
    bounds are joined on the keys instead.
    """
    flags = {"_dep": F.coalesce(is_deposit, F.lit(False)),
             "_wd": F.coalesce(is_withdrawal, F.lit(False))}
    for sfx, w in windows.items():
        flags[f"_win{sfx}"] = F.expr(f"coalesce({w.ts_between_sql('transaction_date')}, false)")
    any_win = " OR ".join(f"_win{sfx}" for sfx in windows)
    aggs = [] if bounds is not None else [
        "min(CASE WHEN _dep THEN transaction_date END) AS first_dep",
        "max(CASE WHEN _dep THEN transaction_date END) AS last_dep"]
    for sfx in windows:
        aggs.append(f"count_if(_win{sfx}) AS win_n{sfx}")
        for side, flag in (("dep", "_dep"), ("wd", "_wd")):
            cond = f"_win{sfx} AND {flag}"
            aggs.append(f"count_if({cond}) AS {side}{sfx}_n")
            for cur, col in _MONEY:
                aggs.append(f"sum(CASE WHEN {cond} THEN {col} END) AS {side}{sfx}_{cur}")
                aggs.append(f"count(CASE WHEN {cond} THEN {col} END) AS {side}{sfx}_{cur}_n")
    if bounds is not None:
        windowed = " OR ".join(w.ts_between_sql("transaction_date") for w in windows.values())
        level1 = _grouped(rows.filter(windowed).withColumns(flags), keys, [*aggs, *extra], resolved)
        # keys are compared with '=': a NULL asset type gets no lifetime bounds
        return level1.join(bounds.select(*keys, "first_dep", "last_dep"), list(keys), "left")
    # rows that are neither deposits nor in a window add nothing
    return _grouped(rows.withColumns(flags).filter(f"_dep OR {any_win}"), keys, [*aggs, *extra], resolved)


def _grouped(rows: DataFrame, keys: list[str], aggs: list[str], resolved,
             pair_keys: list[str] = ()) -> DataFrame:
    """``aggs`` per ``keys`` group; by way of pairs of plan ids if ``resolved`` joins those."""
    if resolved is None:
        return rows.groupBy(*keys).agg(*[F.expr(e) for e in aggs])
    partial = rows.groupBy(*PAIR, *pair_keys).agg(*[F.expr(e) for e in aggs])
    merge = {"first_dep": F.min, "last_dep": F.max}
    names = [e.rsplit(" AS ", 1)[1] for e in aggs]
    return resolved(partial).groupBy(*keys).agg(*[merge.get(n, F.sum)(n).alias(n) for n in names])


def level2_totals(window: Window | None, sfx: str = "", lifetime_ok: str = "true",
            day_test: str | None = None) -> list[Column]:
    """Level 2 measures for one window, over level-1 groups.

    Groups without rows in the window contribute nothing: their sums are
    NULL and their counts 0, and the depositor counts test ``win_n > 0``.
    ``day_test`` replaces the window's whole-day test of the first deposit
    (used when the window bounds are columns).
    """
    if day_test is None:
        day_test = window.day_between_sql("first_dep")
    in_group = f"win_n{sfx} > 0 AND {lifetime_ok}"
    out = []
    for side, name in (("dep", "deposit"), ("wd", "withdrawal")):
        out.append(f"CAST(coalesce(sum({side}{sfx}_n), 0) AS BIGINT) AS {name}_count")
        for cur, _ in _MONEY:
            out.append(f"CAST(sum({side}{sfx}_{cur}) AS DOUBLE) AS {name}_value_{cur}")
    for cur, _ in _MONEY:
        # net flow: no deposits -> NULL; no withdrawals -> deposits
        out.append(f"CAST(sum(dep{sfx}_{cur}) - coalesce(sum(wd{sfx}_{cur}), 0) AS DOUBLE)"
                   f" AS aum_{cur}")
    out += [f"count_if(dep{sfx}_n > 0) AS total_depositors",
            f"count_if(wd{sfx}_n > 0) AS total_withdrawers",
            f"count_if({in_group} AND first_dep < last_dep) AS recurring_depositors",
            f"count_if({in_group} AND first_dep = last_dep AND {day_test}) AS new_depositors"]
    for side, name in (("dep", "deposit"), ("wd", "withdrawal")):
        for cur, _ in _MONEY:
            out.append(f"try_divide(CAST(sum({side}{sfx}_{cur}) AS DOUBLE), "
                       f"sum({side}{sfx}_{cur}_n)) AS avg_{name}_value_{cur}")
    return [F.expr(e) for e in out]


GENERAL_COLUMNS = [
    "deposit_count", "deposit_value_ghs", "deposit_value_usd",
    "withdrawal_count", "withdrawal_value_ghs", "withdrawal_value_usd",
    "aum_ghs", "aum_usd", "total_depositors", "total_withdrawers",
    "recurring_depositors", "new_depositors",
    "avg_deposit_value_ghs", "avg_deposit_value_usd",
    "avg_withdrawal_value_ghs", "avg_withdrawal_value_usd",
]


def general_metrics(t: LedgerTables, window: Window,
                    deposit_types=rd.DEPOSIT_TYPES_PLATFORM,
                    bounds: DataFrame | None = None) -> DataFrame:
    """One row of platform deposit/withdrawal metrics for ``window``.

    Deposits ignore the provider; withdrawals exclude the excluded provider
    (and, by NULL comparison, a missing one).  ``bounds``: an optional stored
    ``ledger.general_deposit_bounds`` table, which lets the job read only the
    window's rows.
    """
    is_dep = F.col("transaction_type").isin(*deposit_types)
    is_wd = (F.col("transaction_type") == rd.WITHDRAWAL_TYPE) & provider_ok()
    small = all_small(t)
    level1 = customer_rollup(
        base_general(t) if small else facts(t), ["customer_id"], {"": window}, is_dep, is_wd, bounds=bounds,
        resolved=None if small else lambda p: by_pair(t, p, assets=False).filter(eligible()))
    return (level1.filter(F.col("win_n") > 0)
            .agg(*level2_totals(window))
            .select(*GENERAL_COLUMNS))


def general_metrics_presets(t: LedgerTables, as_of,
                            presets=PRESETS,
                            deposit_types=rd.DEPOSIT_TYPES_PLATFORM,
                            bounds: DataFrame | None = None) -> DataFrame:
    """J1 for every date preset anchored on ``as_of``: one row per preset.

    One pass over the ledger serves all windows.  Their end points (two a
    preset at most) cut time into cells, each a point or the open stretch
    between two; a row lies in one cell, so rows are not multiplied.  They are
    aggregated per customer and cell (where dimensions are large per pair of
    plan ids first, ``_grouped``), and only those few rows are handed to all
    presets, with a mark whether the preset's window holds the cell: so a customer's first and last deposit
    reach every preset by the same aggregation.
    Presets with no rows still get their row.
    """
    windows = [preset_window(name, as_of) for name in presets]
    points = sorted({d for w in windows for d in (w.start, w.end)})
    stamp = lambda d: f"CAST(DATE '{d}' AS TIMESTAMP_NTZ)"
    cell = " + ".join(f"CAST(transaction_date > {stamp(d)} AS INT) + CAST(transaction_date >= {stamp(d)} AS INT)"
                      for d in points)
    held = [(2 * i + at, n) for n, w in enumerate(windows) for i, d in enumerate(points) for at in (0, 1)
            if (w.start < d <= w.end if at == 0 else w.start <= d <= w.end)]
    small = all_small(t)
    rows = (base_general(t) if small else facts(t)).withColumns({
        "_dep": F.coalesce(F.col("transaction_type").isin(*deposit_types), F.lit(False)),
        "_wd": F.coalesce((F.col("transaction_type") == rd.WITHDRAWAL_TYPE) & provider_ok(),
                          F.lit(False))})
    aggs = ["count(1) AS win_n"]
    for side, flag in (("dep", "_dep"), ("wd", "_wd")):
        aggs.append(f"count_if({flag}) AS {side}_n")
        for cur, col in _MONEY:
            aggs.append(f"sum(CASE WHEN {flag} THEN {col} END) AS {side}_{cur}")
            aggs.append(f"count(CASE WHEN {flag} THEN {col} END) AS {side}_{cur}_n")
    sums = [e.rsplit(" AS ", 1)[1] for e in aggs]
    in_any = " OR ".join(w.ts_between_sql("transaction_date") for w in windows)
    if bounds is None:
        aggs += ["min(CASE WHEN _dep THEN transaction_date END) AS first_dep",
                 "max(CASE WHEN _dep THEN transaction_date END) AS last_dep"]
        rows = rows.filter(f"_dep OR {in_any}")
    else:
        rows = rows.filter(in_any)
    rows = rows.withColumn("cell", F.expr(cell))
    per_cell = _grouped(rows, ["customer_id", "cell"], aggs,
                        None if small else lambda p: by_pair(t, p, assets=False).filter(eligible()),
                        pair_keys=["cell"])
    # A literal table of a row a cell and preset.  Every cell goes to every preset, because any may hold the
    # customer's first or last deposit; only a preset's own cells count in its sums.
    points_ = range(2 * len(points) + 1)
    of_cell = rd.small_table(t.spark, ("cells", tuple(held)), lambda: t.spark.createDataFrame(
        [(c, n, (c, n) in set(held)) for c in points_ for n in range(len(windows))
         if bounds is None or (c, n) in set(held)], "cell int, preset_order int, own boolean"))
    lifetime = [] if bounds is not None else [F.min("first_dep").alias("first_dep"),
                                              F.max("last_dep").alias("last_dep")]
    # grouped by customer already: no further exchange
    per = (per_cell.join(F.broadcast(of_cell), "cell").groupBy("customer_id", "preset_order")
           .agg(*[F.sum(F.when(F.col("own"), F.col(c))).alias(c) for c in sums], *lifetime)
           .filter(F.col("win_n") > 0))
    if bounds is not None:
        per = per.join(bounds.select("customer_id", "first_dep", "last_dep"), "customer_id", "left")
    # one row per preset: bounded by construction
    dims = rd.small_table(t.spark, ("presets", tuple(presets), tuple(windows)),
                          lambda: t.spark.createDataFrame(
        [(i, name, w.start, w.end) for i, (name, w) in enumerate(zip(presets, windows))],
        "preset_order int, preset string, start_date date, end_date date"))
    level2 = (per.join(F.broadcast(dims), "preset_order")
              .groupBy("preset_order")
              .agg(*level2_totals(None, day_test="to_date(first_dep) BETWEEN start_date AND end_date")))
    counts = ["deposit_count", "withdrawal_count", "total_depositors", "total_withdrawers",
              "recurring_depositors", "new_depositors"]
    # level2 has at most one row per preset, so it is the broadcast side of
    # a right join that keeps every preset
    return (F.broadcast(level2).join(dims, "preset_order", "right")
            .select("preset_order", "preset", "start_date", "end_date",
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) if c in counts
                      else F.col(c) for c in GENERAL_COLUMNS]))


ASSET_COLUMNS = [
    "asset_type", "deposit_count", "deposit_value_ghs", "deposit_value_usd",
    "withdrawal_count", "withdrawal_value_ghs", "withdrawal_value_usd",
    "aum_ghs", "aum_usd", "total_depositors", "recurring_depositors", "new_depositors",
    "avg_deposit_value_ghs", "avg_deposit_value_usd",
    "avg_withdrawal_value_ghs", "avg_withdrawal_value_usd",
    "estimated_revenue", "maintenance_fees_ghs", "early_withdrawal_fees_usd",
]


def asset_metrics(t: LedgerTables, window: Window, fees: DataFrame | None = None,
                  deposit_types=rd.DEPOSIT_TYPES_ASSET,
                  bounds: DataFrame | None = None) -> DataFrame:
    """One row per asset type (a NULL type is a row too), ordered by USD
    deposits, largest first.

    ``fees`` is the rate table (asset_type, rate, money, include_withdrawals);
    types without a row earn 0.  Lifetime deposit history is kept per
    customer *and* asset type, and never matches the NULL type, so that row
    has no new or recurring depositors.
    """
    return (asset_rollup(t, window, fees, deposit_types, bounds)
            .select(*ASSET_COLUMNS)
            .orderBy(F.col("deposit_value_usd").desc_nulls_last(),
                     F.col("asset_type").asc_nulls_last()))


def asset_rollup(t: LedgerTables, window: Window, fees: DataFrame | None = None,
                 deposit_types=rd.DEPOSIT_TYPES_ASSET,
                 bounds: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """J4's columns plus ``total_users`` (J6) from the same single pass; with ``only`` of that asset type alone.

    Level-1 groups are (customer, asset type) over exactly J6's rows
    (successful, unrestricted owner, provider kept), so the distinct users of
    a type in the window are its groups with window rows.
    """
    is_dep = F.col("transaction_type").isin(*deposit_types)
    is_wd = F.col("transaction_type") == rd.WITHDRAWAL_TYPE
    small = all_small(t)
    rows = base_asset(t) if small else facts(t).filter(provider_ok())
    wanted = F.lit(True) if only is None else F.col("asset_type") == F.lit(only)
    rows = rows.filter(wanted) if small and only is not None else rows
    extra = [
        f"sum(CASE WHEN _win AND transaction_type = '{rd.FEE_TYPE}' THEN ghs_amount END) AS fee_ghs",
        f"sum(CASE WHEN _win AND transaction_type = '{rd.EARLY_WITHDRAWAL_TYPE}' "
        f"THEN usd_amount END) AS early_usd",
    ]
    level1 = customer_rollup(rows, ["customer_id", "asset_type"], {"": window}, is_dep, is_wd,
                             extra, bounds=bounds,
                             resolved=None if small else lambda p: by_pair(t, p).filter(eligible() & wanted))
    level2 = (level1.filter(F.col("win_n") > 0)
              .groupBy("asset_type")
              .agg(*level2_totals(window, lifetime_ok="asset_type IS NOT NULL"),
                   *[F.expr(e) for e in (
                       "count(1) AS total_users",
                       "sum(dep_ghs) AS _dep_ghs", "sum(dep_usd) AS _dep_usd",
                       "sum(wd_ghs) AS _wd_ghs", "sum(wd_usd) AS _wd_usd",
                       "CAST(sum(fee_ghs) AS DOUBLE) AS maintenance_fees_ghs",
                       f"CAST(sum(early_usd) * CAST({rd.EARLY_WITHDRAWAL_FEE_RATE} AS DECIMAL(4,3))"
                       " AS DOUBLE) AS early_withdrawal_fees_usd")]))
    return (level2.join(_fee_side(t, fees), "asset_type", "left")
            .withColumn("estimated_revenue", estimated_revenue()))


def _fee_side(t: LedgerTables, fees: DataFrame | None) -> DataFrame:
    """The rate table (the job's or the source's own; there is no default), broadcast
    within the row bound, else joined without a hint."""
    fees = t.fees if fees is None else fees
    if fees is None:
        raise ValueError("no fee schedule: give the tables or the job one (asset_type, rate, money, include_withdrawals)")
    return F.broadcast(fees) if row_count_at_most(fees, broadcast_row_limit(t.spark)) else fees


def estimated_revenue() -> Column:
    """Rate x (deposits [+ withdrawals]) in the schedule's currency; 0 if unpriced."""
    zero = F.lit(0).cast("decimal(38,2)")

    def money(side: str) -> Column:
        return F.when(F.col("money") == "ghs", F.col(f"_{side}_ghs")).otherwise(F.col(f"_{side}_usd"))

    base = F.coalesce(money("dep"), zero) + F.when(
        F.col("include_withdrawals"), F.coalesce(money("wd"), zero)).otherwise(zero)
    return F.coalesce(F.col("rate") * base.cast("double"), F.lit(0.0))


def asset_revenue(t: LedgerTables, window: Window, fees: DataFrame | None = None) -> DataFrame:
    """J4r: estimated revenue per asset type."""
    return asset_metrics(t, window, fees).select("asset_type", "estimated_revenue")


def asset_fees(t: LedgerTables, window: Window) -> DataFrame:
    """J4f: maintenance fees (GHS) and early-withdrawal fees (USD) per asset type."""
    return asset_metrics(t, window).select("asset_type", "maintenance_fees_ghs",
                                           "early_withdrawal_fees_usd")


def _window_asset_rows(t: LedgerTables, window: Window, users: bool) -> DataFrame:
    if all_small(t):
        rows = ledger(t, users=users).filter(window.ts_between("transaction_date"))
        rows = rows.filter(provider_ok()) if users else rows
    else:  # which pairs of plan ids have rows, before any join
        seen = facts(t).filter(window.ts_between("transaction_date"))
        seen = seen.filter(provider_ok()) if users else seen
        rows = by_pair(t, seen.select(*PAIR).distinct(), users=users)
    rows = rows.filter(F.col("asset_type").isNotNull())
    return rows.filter(eligible()) if users else rows


def users_by_asset_type(t: LedgerTables, window: Window) -> DataFrame:
    """Distinct unrestricted users per (non-NULL) asset type, most first."""
    return (_window_asset_rows(t, window, users=True)
            .groupBy("asset_type")
            .agg(F.count_distinct("customer_id").alias("total_users"))
            .orderBy(F.col("total_users").desc(), F.col("asset_type")))


def asset_types(t: LedgerTables, window: Window) -> DataFrame:
    """Asset types with successful transactions in the window (no user or
    provider filter), sorted."""
    return (_window_asset_rows(t, window, users=False)
            .select("asset_type").distinct().orderBy("asset_type"))


def asset_type_count(t: LedgerTables, window: Window) -> DataFrame:
    """How many asset types J7 lists."""
    return (_window_asset_rows(t, window, users=False)
            .agg(F.count_distinct("asset_type").alias("asset_type_count")))


def asset_detail(t: LedgerTables, window: Window, selected: str,
                 fees: DataFrame | None = None) -> DataFrame:
    """The asset page for one type: its J4 row plus its J6 user count."""
    return (asset_rollup(t, window, fees, only=selected)
            .select(*ASSET_COLUMNS, "total_users"))


def user_counts(t: LedgerTables, window: Window) -> DataFrame:
    """Sign-ups in the window and KYC-tagged users updated in it (whole days).

    One scan; the OR of the two date ranges is a filter, so Parquet skips
    row groups outside both."""
    signed_up = F.coalesce(window.day_between("created_at"), F.lit(False))
    kyc = F.coalesce(F.col("metadata").cast("string").ilike(rd.KYC_TEXT_PATTERN)
                     & window.day_between("updated_at"), F.lit(False))
    return (t.users.filter(window.day_between("created_at") | window.day_between("updated_at"))
            .agg(F.count_if(signed_up).alias("registered_users"),
                 F.count_if(kyc).alias("kyc_users")))

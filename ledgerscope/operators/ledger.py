"""Staging: the enriched ledger every money metric reads (J17), and the
per-customer summaries built on it (J18-J20).

Join plan
---------
A transaction points to a savings plan, an investment plan, or both.  Its
owner is the savings plan's user if there is one, else the investment plan's
(``COALESCE``), and its asset type prefers the investment plan's asset.
Every dimension is broadcast when its table passed the row-bound check, and
then users are joined once, on the resolved owner: the transactions stream
through the joins without a shuffle.  When users are too many to broadcast,
their attributes (restriction flag, sign-up date, name) are joined onto each
plan dimension *before* the dimensions meet the fact table, and the owner's
attributes are picked per row, so the fact table takes part in two shuffled
joins (one per plan kind) instead of three.  Dimensions are never larger
than the user base; the transaction table is the only relation that grows
with activity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope import reference_data as rd
from ledgerscope.operators.instants import blocks_of, distinct_instants, merged_blocks
from ledgerscope.operators.joins import dimension_join, heavy_keys
from ledgerscope.sources.tables import LedgerTables

def _user_columns(t: LedgerTables, first: DataFrame | None = None) -> DataFrame:
    """The owners' attributes; with ``first`` (J19) their first transaction as ``first_transaction_date``."""
    owners = t.users.select(F.col("id").alias("u_id"), "restricted",
                            F.col("created_at").alias("sign_up_date"),
                            "first_name", "last_name")
    if first is None:
        return owners
    return owners.join(first.withColumnRenamed("user_id", "_first_of"), F.col("u_id") == F.col("_first_of"),
                       "left").drop("_first_of")


def _with_user_attrs(t: LedgerTables, dim: DataFrame, key: str, prefix: str,
                     spread_by: str, first: DataFrame | None = None) -> DataFrame:
    """Left-join the user attributes onto a plan dimension (large user base:
    a sort-merge join of two dimension-sized tables)."""
    owners = _user_columns(t, first)
    joined = dimension_join(dim, key, owners, "u_id", small=t.is_small("users"), spread_by=spread_by)
    return joined.withColumnsRenamed({c: f"{prefix}{c}" for c in owners.columns})


def savings_dimension(t: LedgerTables, users: bool = True, first: DataFrame | None = None) -> DataFrame:
    dim = t.plans.select(F.col("id").alias("p_id"), F.col("user_id").alias("p_user_id"),
                         F.col("plan_option").alias("p_option"))
    if users:
        dim = _with_user_attrs(t, dim, "p_user_id", "p_", spread_by="p_id", first=first)
    return dim


def investment_dimension(t: LedgerTables, users: bool = True,
                         assets: bool = True, first: DataFrame | None = None) -> DataFrame:
    dim = t.investment_plans.select(
        F.col("id").alias("ip_id"), F.col("user_id").alias("ip_user_id"),
        F.col("asset_id"), F.col("plan_option").alias("ip_option"),
        F.col("maturity_date").alias("investment_maturity_date"))
    if assets:
        a = t.assets.select(F.col("id").alias("a_id"), F.col("name").alias("asset_name"),
                            F.col("maturity_date").alias("assets_maturity_date"))
        dim = dimension_join(dim, "asset_id", a, "a_id", small=t.is_small("assets"),
                             spread_by="ip_id").drop("a_id")
    if users:
        dim = _with_user_attrs(t, dim, "ip_user_id", "ip_", spread_by="ip_id", first=first)
    return dim


def transaction_type(metadata: Column, tx_type: Column) -> Column:
    """Raw type, except fee deductions recognised from the metadata text."""
    return F.when(metadata.ilike(rd.FEE_TEXT_PATTERN), F.lit(rd.FEE_TYPE)).otherwise(tx_type)


def ledger(t: LedgerTables, *, users: bool = True, assets: bool = True,
           success_only: bool = True) -> DataFrame:
    """One row per transaction with owner, class and asset attributes (see
    ``build_ledger``); staged once per table registry."""
    return t.staged(("ledger", users, assets, success_only),
                    lambda: build_ledger(t, users=users, assets=assets,
                                         success_only=success_only))


def build_ledger(t: LedgerTables, *, users: bool = True, assets: bool = True,
                 success_only: bool = True) -> DataFrame:
    """One row per transaction with owner, class and asset attributes.

    Columns: transaction_id, plan_id, investment_plan_id, tx_type (raw),
    transaction_type (fee rows reclassified), transaction_date, ghs_amount,
    usd_amount, exchange_rate, provider, p_user_id, ip_user_id, owner_id,
    asset_type, investment_type; with ``users``: customer_id (NULL when the
    owner is not a known user), restricted, sign_up_date, customer_name; with
    ``assets``: asset_name, assets_maturity_date, investment_maturity_date.
    """
    return resolve(t, facts(t, success_only), "transaction_id", users=users, assets=assets)


def facts(t: LedgerTables, success_only: bool = True) -> DataFrame:
    """The transactions' own columns, classified; nothing joined."""
    tx = t.transactions
    if success_only:
        tx = tx.filter(F.col("status") == "success")
    return tx.select(
        F.col("id").alias("transaction_id"), "plan_id", "investment_plan_id",
        F.col("tx_type"),
        transaction_type(F.col("metadata").cast("string"), F.col("tx_type")).alias("transaction_type"),
        F.col("updated_at").alias("transaction_date"),
        F.col("amount").alias("ghs_amount"), "usd_amount", "exchange_rate",
        F.col("provider_number").alias("provider"))


PAIR = ["plan_id", "investment_plan_id"]


def all_small(t: LedgerTables) -> bool:
    """Whether every dimension of the ledger is broadcast."""
    return all(t.is_small(n) for n in ("plans", "investment_plans", "users", "assets"))


def by_pair(t: LedgerTables, partial: DataFrame, *, users: bool = True, assets: bool = True) -> DataFrame:
    """Owner, class and asset attributes for ``partial``, aggregates per pair of plan ids.

    Owner and asset depend on the pair alone, so where dimensions are too
    large to broadcast the fact is aggregated by pair first (map-side
    combined: a plan with a third of all rows is one row a task) and only the
    partials meet the dimensions.
    """
    keyed = partial.withColumn("_pair", F.coalesce("investment_plan_id", "plan_id", F.lit(0)))
    return resolve(t, keyed, "_pair", users=users, assets=assets).drop("_pair")


def resolve(t: LedgerTables, fact: DataFrame, spread_by: str, *, users: bool = True,
            assets: bool = True, first: DataFrame | None = None, hot: bool = False) -> DataFrame:
    """``fact`` (any rows with the two plan ids) with the plans' and the owner's attributes.

    ``spread_by``: a column that scatters rows without a plan id.  ``first``: the owners' first
    transactions (J19), which come along as an attribute of the owner.  ``hot``: ``fact`` are raw rows, of
    which one plan may have a large part (``joins.dimension_join``).
    """
    # Users within the broadcast bound are joined once, on the owner, after
    # both plan joins (no shuffle either way).  Larger user bases are joined
    # onto the plan dimensions first, which spares the fact table a third
    # shuffle.
    users_once = users and t.is_small("users")
    pre_join = users and not users_once
    inv = investment_dimension(t, users=pre_join, assets=assets, first=first)
    sav = savings_dimension(t, users=pre_join, first=first)
    # the dimensions have as many rows as their plan tables (unique-key joins)
    heavy = {c: heavy_keys(fact, c) if hot and not t.is_small(n) else () for c, n in
             (("investment_plan_id", "investment_plans"), ("plan_id", "plans"))}
    j = dimension_join(fact, "investment_plan_id", inv, "ip_id", small=t.is_small("investment_plans"),
                       spread_by=spread_by, heavy=heavy["investment_plan_id"])
    j = dimension_join(j, "plan_id", sav, "p_id",
                       small=t.is_small("plans"), spread_by=spread_by, heavy=heavy["plan_id"])
    if users_once:
        j = j.join(F.broadcast(_user_columns(t, first)),
                   F.coalesce("p_user_id", "ip_user_id") == F.col("u_id"), "left")

    has_inv = F.col("investment_plan_id").isNotNull()
    has_sav = F.col("plan_id").isNotNull()
    cols = [
        *fact.columns, "p_user_id", "ip_user_id",
        F.col("ip_id").isNotNull().alias("has_investment_plan"),
        F.col("p_id").isNotNull().alias("has_savings_plan"),
        F.coalesce("p_user_id", "ip_user_id").alias("owner_id"),
        F.when(has_inv, F.col("asset_name") if assets else F.lit(None).cast("string"))
         .when(has_sav, F.col("p_option")).alias("asset_type"),
        F.when(has_inv, F.col("ip_option")).when(has_sav, F.col("p_option")).alias("investment_type"),
    ]
    if assets:
        cols += ["asset_name", "assets_maturity_date", "investment_maturity_date"]
    if users_once:
        cols += [F.col("u_id").alias("customer_id"), "restricted", "sign_up_date",
                 F.concat("first_name", F.lit(" "), "last_name").alias("customer_name")]
        cols += [] if first is None else ["first_transaction_date"]
    elif users:
        # the owner is the savings plan's user when that plan names one
        by_savings = F.col("p_user_id").isNotNull()

        def owner_attr(name: str) -> Column:
            return F.when(by_savings, F.col(f"p_{name}")).otherwise(F.col(f"ip_{name}"))

        cols += [
            owner_attr("u_id").alias("customer_id"),
            owner_attr("restricted").alias("restricted"),
            owner_attr("sign_up_date").alias("sign_up_date"),
            F.concat(owner_attr("first_name"), F.lit(" "), owner_attr("last_name")).alias("customer_name"),
        ]
        cols += [] if first is None else [owner_attr("first_transaction_date").alias("first_transaction_date")]
    return j.select(*cols)


def eligible() -> Column:
    """Owner is a known, unrestricted user (``restricted = false``; NULL fails)."""
    return F.col("restricted") == F.lit(False)


def provider_ok() -> Column:
    """``provider <> 'Flex Dollar'``: a NULL provider fails too."""
    return F.col("provider") != F.lit(rd.EXCLUDED_PROVIDER)


def base_general(t: LedgerTables) -> DataFrame:
    """Rows behind the platform metrics (success, unrestricted owner)."""
    return t.staged("base_general", lambda: ledger(t, assets=False).filter(eligible()))


def base_asset(t: LedgerTables) -> DataFrame:
    """Rows behind the per-asset metrics: also drops the excluded provider."""
    return t.staged("base_asset", lambda: ledger(t).filter(eligible() & provider_ok()))


def ledger_base(t: LedgerTables) -> DataFrame:
    """J17 as a result: the enriched rows of the platform metrics."""
    rows = base_general(t) if all_small(t) else resolve(t, facts(t), "transaction_id", assets=False, hot=True).filter(eligible())
    return rows.select(
        "customer_id", "customer_name", "transaction_id", "transaction_type",
        "transaction_date", "ghs_amount", "usd_amount", F.col("provider").alias("pn"))


def _deposit_summary(rows: DataFrame, keys: list[str], deposit_types, resolved) -> DataFrame:
    """Rows, first and number of different instants of the deposits per ``keys``.

    The instants are counted as sets per half hour (``instants.blocks_of``), united per ``keys``
    and half hour: sets are collected in each task first, and a depositor's blocks lie in many
    tasks.  Where dimensions are large the blocks are made per pair of plan ids, before the joins.
    """
    deposits = rows.filter(F.col("transaction_type").isin(*deposit_types))
    if resolved is None:
        return distinct_instants(blocks_of(deposits, keys), keys)
    owned = resolved(blocks_of(deposits, PAIR))
    return distinct_instants(merged_blocks(owned, keys), keys)


def depositors_summary(t: LedgerTables) -> DataFrame:
    """Lifetime deposit history per customer (platform deposit classes)."""
    small = all_small(t)
    return _deposit_summary(base_general(t) if small else facts(t), ["customer_id"], rd.DEPOSIT_TYPES_PLATFORM,
                            None if small else lambda p: by_pair(t, p, assets=False).filter(eligible()))


def depositors_by_asset(t: LedgerTables) -> DataFrame:
    """Lifetime deposit history per customer and asset type."""
    small = all_small(t)
    return _deposit_summary(base_asset(t) if small else facts(t).filter(provider_ok()), ["customer_id", "asset_type"],
                            rd.DEPOSIT_TYPES_ASSET, None if small else lambda p: by_pair(t, p).filter(eligible()))


def deposit_bounds(rows: DataFrame, keys: list[str], deposit_types) -> DataFrame:
    """Lifetime first and last deposit instant per ``keys`` group.

    This is all the two-level metrics need of the lifetime history ("one
    deposit instant" is first = last, "several" is first < last), and it is
    mergeable: bounds of old rows and bounds of newly appended rows combine
    by min / max (``merge_deposit_bounds``).  Stored once in the shared
    folder, it lets every window query read only the window's rows.
    """
    if deposit_types is not None:
        rows = rows.filter(F.col("transaction_type").isin(*deposit_types))
    return (rows.groupBy(*keys)
            .agg(F.min("transaction_date").alias("first_dep"),
                 F.max("transaction_date").alias("last_dep")))


def general_deposit_bounds(t: LedgerTables) -> DataFrame:
    """Bounds for the platform metrics (J1): per customer, deposit + direct debit."""
    return deposit_bounds(base_general(t), ["customer_id"], rd.DEPOSIT_TYPES_PLATFORM)


def asset_deposit_bounds(t: LedgerTables) -> DataFrame:
    """Bounds for the per-asset metrics (J4): per customer and asset type."""
    return deposit_bounds(base_asset(t), ["customer_id", "asset_type"], rd.DEPOSIT_TYPES_ASSET)


def merge_deposit_bounds(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds over old + appended rows, from the two bounds tables alone."""
    return (old.unionByName(new).groupBy(*keys)
            .agg(F.min("first_dep").alias("first_dep"), F.max("last_dep").alias("last_dep")))


def first_transactions(t: LedgerTables) -> DataFrame:
    """Earliest successful transaction per owner (NULL owner is a group)."""
    earliest = facts(t).groupBy(*PAIR).agg(F.min("transaction_date").alias("transaction_date"))
    rows = ledger(t, users=False, assets=False) if all_small(t) else by_pair(
        t, earliest, users=False, assets=False)
    return (rows.groupBy(F.col("owner_id").alias("user_id"))
            .agg(F.min("transaction_date").alias("first_transaction_date")))


def ledger_cohorts(t: LedgerTables) -> DataFrame:
    """Per-row cohort attributes of the asset ledger.

    The first transaction is an attribute of the owner and comes with the plan dimensions, so
    raw rows take part in the two plan joins and no third one.
    """
    rows = resolve(t, facts(t), "transaction_id", first=first_transactions(t), hot=True)
    return (rows.filter(eligible() & provider_ok())
            .select("transaction_id", "transaction_type", "asset_type", "customer_id",
                    "customer_name", "first_transaction_date",
                    F.date_format("transaction_date", "yyyy-MM").alias("transaction_cohort"),
                    F.date_format("sign_up_date", "yyyy-MM").alias("sign_up_cohort"),
                    F.weekofyear("transaction_date").alias("week_number"),
                    "transaction_date", "ghs_amount", "usd_amount", "exchange_rate",
                    "sign_up_date", "investment_type", "asset_name",
                    "assets_maturity_date", "investment_maturity_date"))



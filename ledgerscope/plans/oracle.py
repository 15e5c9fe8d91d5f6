"""DuckDB oracle: for each registered key an independent statement over the
fixture tables.

The Spark jobs aggregate partial results; these statements keep every row.
Owner, asset and instrument are settled once per pair of plan ids (``pair``);
each ledger row carries its depositor's first and last deposit instant from a
window function (``life``); flags are ``EXISTS`` tests on one activity list;
rates are a ``VALUES`` table; cards are an ``UNPIVOT`` joined to the expected
labels.  Expected names, dates and rates are written out here, not taken from
the engine.  Money is summed as DECIMAL and cast at the end on both sides.
"""

from __future__ import annotations

from ledgerscope import reference_data as rd
from ledgerscope.sources.fixtures import duckdb_prelude

_LEDGER_VIEWS = ["fx_transactions", "fx_plans", "fx_investment_plans", "fx_users", "fx_assets"]
_USER_VIEWS = [*_LEDGER_VIEWS, "fx_profiles", "fx_budgets", "fx_external_transactions", "fx_messages"]

# The registered window, 2024-01-05 to 2024-01-20: instants up to the last midnight; whole days.
_MOMENT = "BETWEEN CAST(DATE '2024-01-05' AS TIMESTAMP) AND CAST(DATE '2024-01-20' AS TIMESTAMP)"
_DAY = "BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"
_LABEL = "'January 05, 2024 → January 20, 2024'"

# Presets as of Wednesday 2024-01-31.
_PRESETS = """preset AS (
  SELECT * FROM (VALUES
    (0, 'Today', DATE '2024-01-31', DATE '2024-01-31'),
    (1, 'Past 7 Days', DATE '2024-01-25', DATE '2024-01-31'),
    (2, 'Last 14 Days', DATE '2024-01-18', DATE '2024-01-31'),
    (3, 'This Week', DATE '2024-01-28', DATE '2024-01-31'),
    (4, 'Last Week', DATE '2024-01-22', DATE '2024-01-28'),
    (5, 'Last 30 Days', DATE '2024-01-02', DATE '2024-01-31'),
    (6, 'Last Month', DATE '2023-12-01', DATE '2023-12-31'),
    (7, 'All Time', DATE '2022-01-01', DATE '2024-01-31')
  ) AS v (preset_order, preset, start_date, end_date))"""

# ---- rows ----------------------------------------------------------------------------------------

_PAIR = """pair AS (
  SELECT k.plan_id, k.investment_plan_id,
    CASE WHEN s.id IS NOT NULL THEN TRUE ELSE FALSE END AS saves, s.user_id AS saver,
    CASE WHEN i.id IS NOT NULL THEN TRUE ELSE FALSE END AS invests, i.user_id AS investor,
    COALESCE(s.user_id, i.user_id) AS owner_id,
    CASE WHEN k.investment_plan_id IS NULL THEN s.plan_option ELSE a.name END AS asset,
    CASE WHEN k.investment_plan_id IS NULL THEN s.plan_option ELSE i.plan_option END AS instrument,
    a.name AS asset_name, a.maturity_date AS asset_matures, i.maturity_date AS plan_matures
  FROM (SELECT plan_id, investment_plan_id FROM fx_transactions GROUP BY plan_id, investment_plan_id) k
  LEFT JOIN fx_plans s ON s.id = k.plan_id
  LEFT JOIN fx_investment_plans i ON i.id = k.investment_plan_id
  LEFT JOIN fx_assets a ON a.id = i.asset_id)"""

_ENTRY = """entry AS (
  SELECT x.id AS entry_id, x.tx_type AS raw_kind, x.updated_at AS moment, x.provider_number AS provider,
    CASE WHEN contains(lower(x.metadata), 'monthly maintenance fee deduction') THEN 'maintenance_fee'
         ELSE x.tx_type END AS kind,
    x.amount AS ghs, x.usd_amount AS usd, x.exchange_rate, pair.owner_id, pair.asset, pair.instrument,
    pair.saves, pair.saver, pair.invests, pair.investor, pair.asset_name, pair.asset_matures, pair.plan_matures,
    w.id AS customer, w.first_name || ' ' || w.last_name AS customer_name, w.created_at AS joined,
    CASE WHEN w.restricted THEN FALSE WHEN NOT w.restricted THEN TRUE END AS free
  FROM (SELECT * FROM fx_transactions WHERE status = 'success') x
  JOIN pair ON x.plan_id IS NOT DISTINCT FROM pair.plan_id
    AND x.investment_plan_id IS NOT DISTINCT FROM pair.investment_plan_id
  LEFT JOIN fx_users w ON w.id = pair.owner_id)"""


def _life(name: str, deposits: str, per: str, rows: str, withdrawal: str = "kind = 'withdrawal'") -> str:
    """Rows with their side and their depositor's first and last deposit, ever."""
    side = f"CASE WHEN kind IN ({deposits}) THEN 'in' WHEN {withdrawal} THEN 'out' END"
    return f"""{name}_sides AS (SELECT *, {side} AS side FROM entry WHERE {rows}),
{name} AS (
  SELECT *, MIN(CASE WHEN side = 'in' THEN moment END) OVER (PARTITION BY {per}) AS opened,
    MAX(CASE WHEN side = 'in' THEN moment END) OVER (PARTITION BY {per}) AS latest
  FROM {name}_sides)"""


_PLATFORM = _life("platform", "'deposit', 'direct_debit'", "customer", "free",
                  "kind = 'withdrawal' AND provider <> 'Flex Dollar'")
_HOLDING = _life("holding", "'deposit'", "customer, asset", "free AND provider <> 'Flex Dollar'")


def _flows(source: str, keys: str, day: str, where: str, known: str = "TRUE") -> str:
    """Sums and heads of ``source`` per ``keys``."""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""

    def of(side: str, what: str) -> str:
        return f"CASE WHEN side = '{side}' THEN {what} END"

    sums = ", ".join(f"SUM({of(s, c)}) AS {c}_{s}, COUNT({of(s, c)}) AS {c}_{s}_n, COUNT({of(s, '1')}) AS {s}_n"
                     if c == "ghs" else f"SUM({of(s, c)}) AS {c}_{s}, COUNT({of(s, c)}) AS {c}_{s}_n"
                     for s in ("in", "out") for c in ("ghs", "usd"))
    return f"""SELECT {lead}{sums},
    COUNT(DISTINCT {of('in', 'customer')}) AS payers, COUNT(DISTINCT {of('out', 'customer')}) AS takers,
    COUNT(DISTINCT CASE WHEN {known} AND opened < latest THEN customer END) AS returning_n,
    COUNT(DISTINCT CASE WHEN {known} AND opened = latest AND CAST(opened AS DATE) {day} THEN customer END) AS fresh_n,
    COUNT(DISTINCT customer) AS heads,
    SUM(CASE WHEN kind = 'maintenance_fee' THEN ghs END) AS upkeep,
    SUM(CASE WHEN kind = 'early_withdrawal' THEN usd END) AS early
  FROM {source} {where} {group}"""


# Result column -> expression over a row of ``_flows``.
_MEASURES = {
    "total_depositors": "payers",
    "total_withdrawers": "takers",
    "new_depositors": "fresh_n",
    "recurring_depositors": "returning_n",
    "deposit_count": "in_n",
    "withdrawal_count": "out_n",
}
for _cur in ("ghs", "usd"):
    _MEASURES |= {
        f"aum_{_cur}": f"CAST({_cur}_in - COALESCE({_cur}_out, 0) AS DOUBLE)",
        f"deposit_value_{_cur}": f"CAST({_cur}_in AS DOUBLE)",
        f"withdrawal_value_{_cur}": f"CAST({_cur}_out AS DOUBLE)",
        f"avg_deposit_value_{_cur}": f"CAST({_cur}_in AS DOUBLE) / NULLIF({_cur}_in_n, 0)",
        f"avg_withdrawal_value_{_cur}": f"CAST({_cur}_out AS DOUBLE) / NULLIF({_cur}_out_n, 0)",
    }
_MEASURE_LIST = ", ".join(f"{v} AS {k}" for k, v in sorted(_MEASURES.items()))

_RATES = """rates AS (
  SELECT * FROM (VALUES
    ('equity', 2e-2, 'ghs', FALSE), ('fund', 2e-2, 'ghs', FALSE), ('etf', 2e-2, 'usd', FALSE),
    ('spread_trade', 1e-2, 'ghs', TRUE), ('credit_fund', 4e-2 / 12, 'usd', FALSE),
    ('fixed_income', 2e-2 / 12, 'usd', FALSE), ('savings_usd_a', 4.75e-2 / 12, 'usd', FALSE),
    ('savings_usd_b', 6e-2 / 12, 'usd', FALSE), ('savings_usd_c', 6e-2 / 12, 'usd', FALSE)
  ) AS v (priced, rate, money, both_ways))"""

_ASSET_ROWS = f"""asset_flow AS (
  {_flows('holding', 'asset', _DAY, f'WHERE moment {_MOMENT}', 'asset IS NOT NULL')}),
asset_row AS (
  SELECT asset AS asset_type, {", ".join(f"{v} AS {k}" for k, v in sorted(_MEASURES.items()) if k != "total_withdrawers")},
    COALESCE(rate * CAST(CASE WHEN money = 'ghs' THEN COALESCE(ghs_in, 0) ELSE COALESCE(usd_in, 0) END
      + CASE WHEN both_ways THEN CASE WHEN money = 'ghs' THEN COALESCE(ghs_out, 0) ELSE COALESCE(usd_out, 0) END
             ELSE 0 END AS DOUBLE), CAST(0 AS DOUBLE)) AS estimated_revenue,
    CAST(upkeep AS DOUBLE) AS maintenance_fees_ghs,
    CAST(CAST(early AS DECIMAL(38,2)) * CAST(0.025 AS DECIMAL(4,3)) AS DOUBLE) AS early_withdrawal_fees_usd,
    heads AS total_users
  FROM asset_flow LEFT JOIN rates ON priced = asset)"""

_ASSET_COLUMNS = ["asset_type", *sorted(k for k in _MEASURES if k != "total_withdrawers"), "estimated_revenue",
                  "maintenance_fees_ghs", "early_withdrawal_fees_usd"]

# ---- users ---------------------------------------------------------------------------------------

_SIGNED_UP = f"""SELECT
  SUM(CASE WHEN CAST(created_at AS DATE) {_DAY} THEN 1 ELSE 0 END)::BIGINT AS registered_users,
  SUM(CASE WHEN contains(lower(metadata), 'kyc_completed') AND CAST(updated_at AS DATE) {_DAY} THEN 1
           ELSE 0 END)::BIGINT AS kyc_users
FROM fx_users"""

_SEEN = f"""seen AS (
  SELECT who FROM (
    SELECT CAST(saver AS VARCHAR) AS who, moment FROM entry WHERE saves
    UNION ALL SELECT CAST(investor AS VARCHAR), moment FROM entry WHERE invests
    UNION ALL SELECT CAST(user_ref AS VARCHAR), created_at FROM fx_messages
    UNION ALL SELECT CAST(user_id AS VARCHAR), created_at FROM fx_external_transactions
    UNION ALL SELECT CAST(user_id AS VARCHAR), created_at FROM fx_budgets) every_act
  WHERE moment {_MOMENT})"""

_COHORT = f"""cohort AS (
  SELECT CAST(w.id AS VARCHAR) AS user_id, w.gender, w.country, w.dob, w.status, w.use_option,
    q.employment_status, w.created_at,
    COALESCE(CAST(w.most_recent_activity AS DATE) {_DAY}, FALSE) AS is_recent,
    EXISTS (SELECT 1 FROM seen WHERE who = CAST(w.id AS VARCHAR)) AS is_active
  FROM (SELECT * FROM fx_users WHERE created_at {_MOMENT}) w
  LEFT JOIN fx_profiles q ON q.user_id = w.id)"""

# the characters Python's str.strip() removes, in RE2 syntax
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _bare(column: str) -> str:
    return f"regexp_replace({column}, '^{_WS}+|{_WS}+$', '', 'g')"


_TIDY = f"""tidy AS (
  SELECT user_id, replace(lower({_bare('gender')}), 'non binary', 'non-binary') AS gender,
    {_bare('country')} AS country, TRY_CAST(dob AS DATE) AS dob,
    replace(lower({_bare('status')}), 'kyc_verifeid', 'kyc_verified') AS status,
    regexp_replace(lower({_bare('use_option')}), '^investment$', 'investments') AS use_option,
    employment_status, created_at, is_recent, is_active,
    CAST(2024 - year(TRY_CAST(dob AS DATE)) AS INTEGER) AS age
  FROM cohort),
bins AS (
  SELECT 18 + 5 * n AS lo, format('[{{}}, {{}})', 18 + 5 * n, 23 + 5 * n) AS age_group FROM range(12) r(n)),
grouped AS (SELECT tidy.*, age_group FROM tidy LEFT JOIN bins ON age BETWEEN lo AND lo + 4)"""

# ---- cards: (metric, label, shown as, prefix) ----------------------------------------------------

_GENERAL_CARDS = [
    ("deposit_value_ghs", "Total Deposits (GHS)", "money", "₵"), ("deposit_value_usd", "Total Deposits (USD)", "money", "$"),
    ("deposit_count", "Total Deposits Count", "int", ""), ("withdrawal_value_ghs", "Total Withdrawals (GHS)", "money", "₵"),
    ("withdrawal_value_usd", "Total Withdrawals (USD)", "money", "$"), ("withdrawal_count", "Total Withdrawals Count", "int", ""),
    ("aum_ghs", "Assets Under Management (AUM) GHS", "money", "₵"), ("aum_usd", "Assets Under Management (AUM) USD", "money", "$"),
    ("new_depositors", "New Depositors", "int", ""), ("recurring_depositors", "Recurring Depositors", "int", ""),
    ("registered_users", "Registered Users", "int", ""), ("kyc_users", "KYC Verified Users", "int", ""),
]
_ASSET_CARDS = [
    ("deposit_value_ghs", "Total Deposits (GHS)", "money", "₵"), ("deposit_value_usd", "Total Deposits (USD)", "money", "$"),
    ("deposit_count", "📥 Deposit Count", "int", ""), ("withdrawal_value_ghs", "💸 Withdrawal (GHS)", "money", "₵"),
    ("withdrawal_value_usd", "Withdrawal (USD)", "money", "$"), ("withdrawal_count", "📥 Total Withdrawals Count", "int", ""),
    ("aum_ghs", "📊 AUM (GHS)", "money", ""), ("aum_usd", "📊 AUM (USD)", "money", ""),
    ("total_depositors", "👥 Total Depositors", "int", ""), ("new_depositors", "🆕 New Depositors", "int", ""),
    ("recurring_depositors", "🔁 Recurring Depositors", "int", ""), ("avg_deposit_value_ghs", "💰 Avg Deposit (GHS)", "money", ""),
    ("avg_deposit_value_usd", "💰 Avg Deposit (USD)", "money", ""), ("avg_withdrawal_value_ghs", "💸 Avg Withdrawal (GHS)", "money", ""),
    ("avg_withdrawal_value_usd", "💸 Avg Withdrawal (USD)", "money", ""), ("estimated_revenue", "💰 Estimated Revenue", "money", ""),
    ("total_users", "👥 Total Users", "int", ""),
]
_USER_CARDS = [("registered_users", "🧍 Total Registered Users", "plain", ""), ("active_users", "🟢 Active Users", "plain", ""),
               ("users_with_most_recent_activity", "👤 Users With Recent Activity", "plain", "")]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cards(cards: list, wide: str, ids: str = "") -> str:
    """Cards of the wide rows ``wide`` (a relation), with ``ids`` kept."""
    table = ",\n    ".join(
        f"({i}, {_quoted(m)}, {_quoted(label)}, {_quoted(shown)}, {_quoted(prefix)}, {_quoted(rd.METRIC_EXPLANATIONS[m])})"
        for i, (m, label, shown, prefix) in enumerate(cards, 1))
    columns = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m, *_ in cards)
    keep = f"{ids}, " if ids else ""
    return f"""card AS (SELECT * FROM (VALUES
    {table}) AS v (card_order, metric, label, shown, prefix, explanation)),
long AS (
  FROM (SELECT {keep}{columns} FROM {wide}) UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(m for m, *_ in cards)})))
SELECT {keep}card_order, metric, label, value,
  CASE shown WHEN 'plain' THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
    WHEN 'int' THEN prefix || COALESCE(format('{{:,}}', CAST(TRUNC(value) AS BIGINT)), '0')
    ELSE prefix || COALESCE(format('{{:,.2f}}', value), '0.00') END AS display_value,
  explanation, {_LABEL} AS period_label
FROM long JOIN card USING (metric)"""


# ---- statements ----------------------------------------------------------------------------------

_TREND_ROWS = f"FROM entry WHERE free AND provider <> 'Flex Dollar' AND moment {_MOMENT}"


def _trend(grain: str) -> str:
    return (f"SELECT CAST(date_trunc('{grain}', moment) AS DATE) AS period, raw_kind AS tx_type, "
            f"CAST(SUM(ghs) AS DOUBLE) AS total_amount {_TREND_ROWS} GROUP BY ALL")


_PIVOT = f"""SELECT CAST(moment AS DATE) AS period,
  CAST(SUM(CASE WHEN raw_kind = 'deposit' THEN COALESCE(ghs, 0) ELSE 0 END) AS DOUBLE) AS "Deposits",
  CAST(SUM(CASE WHEN raw_kind = 'withdrawal' THEN COALESCE(ghs, 0) ELSE 0 END) AS DOUBLE) AS "Withdrawals",
  CAST(SUM(CASE WHEN raw_kind = 'direct_debit' THEN COALESCE(ghs, 0) ELSE 0 END) AS DOUBLE) AS direct_debit,
  CAST(SUM(CASE WHEN raw_kind = 'early_withdrawal' THEN COALESCE(ghs, 0) ELSE 0 END) AS DOUBLE) AS early_withdrawal,
  CAST(SUM(CASE WHEN COALESCE(raw_kind, 'none') IN ('deposit', 'withdrawal', 'direct_debit', 'early_withdrawal') THEN 0
                ELSE COALESCE(ghs, 0) END) AS DOUBLE) AS "Other"
{_TREND_ROWS} GROUP BY 1"""

# The fixture's types; a row without one is in Other.
_PRESENT = {"deposit": "Deposits", "direct_debit": "direct_debit", "early_withdrawal": "early_withdrawal", "refund": "refund",
            "withdrawal": "Withdrawals"}
_PIVOT_PRESENT = ("SELECT CAST(moment AS DATE) AS period, " + ", ".join(
    f"CAST(SUM(CASE WHEN raw_kind = '{kind}' THEN COALESCE(ghs, 0) ELSE 0 END) AS DOUBLE) AS \"{name}\""
    for kind, name in _PRESENT.items())
    + f", CAST(SUM(CASE WHEN raw_kind IS NULL THEN COALESCE(ghs, 0) ELSE 0 END) AS DOUBLE) AS \"Other\" {_TREND_ROWS} GROUP BY 1")

_GENERAL = f"SELECT {_MEASURE_LIST} FROM ({_flows('platform', '', _DAY, f'WHERE moment {_MOMENT}')}) f"

_PRESET_ROWS = f"""within AS (
  SELECT preset_order, preset, start_date, end_date, platform.*
  FROM preset LEFT JOIN platform ON moment BETWEEN CAST(start_date AS TIMESTAMP) AND CAST(end_date AS TIMESTAMP))
SELECT preset_order, preset, start_date, end_date, {_MEASURE_LIST}
FROM ({_flows('within', 'preset_order, preset, start_date, end_date', 'BETWEEN start_date AND end_date', '')}) f"""


def _deposits(source: str, keys: str) -> str:
    return (f"SELECT {keys}, COUNT(*) AS deposit_count, MIN(moment) AS first_deposit_date, "
            f"COUNT(DISTINCT moment) AS tx_days FROM {source} WHERE side = 'in' GROUP BY ALL")


_FIRST = "SELECT owner_id AS user_id, MIN(moment) AS first_transaction_date FROM entry GROUP BY ALL"

_COHORTS = """SELECT entry_id AS transaction_id, kind AS transaction_type, asset AS asset_type, customer AS customer_id,
  customer_name, first_moment AS first_transaction_date, strftime(moment, '%Y-%m') AS transaction_cohort,
  strftime(joined, '%Y-%m') AS sign_up_cohort, CAST(week(moment) AS INTEGER) AS week_number, moment AS transaction_date,
  ghs AS ghs_amount, usd AS usd_amount, exchange_rate, joined AS sign_up_date, instrument AS investment_type, asset_name,
  asset_matures AS assets_maturity_date, plan_matures AS investment_maturity_date
FROM (SELECT *, MIN(moment) OVER (PARTITION BY owner_id) AS first_moment FROM entry) e
WHERE free AND provider <> 'Flex Dollar'"""

_TYPES = f"SELECT asset AS asset_type FROM entry WHERE asset IS NOT NULL AND moment {_MOMENT} GROUP BY asset"
_HEADS = "SELECT asset_type, total_users FROM asset_row WHERE asset_type IS NOT NULL"
_KPIS = """SELECT COUNT(*) AS registered_users, COUNT(CASE WHEN is_active THEN 1 END) AS active_users,
  COUNT(CASE WHEN is_recent THEN 1 END) AS users_with_most_recent_activity FROM cohort"""
_AGES = "SELECT bins.age_group, COUNT(age) AS count FROM bins LEFT JOIN tidy ON age BETWEEN lo AND lo + 4 GROUP BY bins.age_group"


def _counted(column: str) -> str:
    return f"SELECT {column}, COUNT(*) AS count FROM tidy WHERE {column} IS NOT NULL GROUP BY {column}"


def _mart_cells(dists: dict[str, str]) -> list[str]:
    """One select a table and column of the mart: ``table_name, row_key, metric, value, value_text``."""
    def cell(table: str, source: str, key: str, metric: str, number: str = "NULL", text: str = "NULL") -> str:
        return (f"SELECT '{table}' AS table_name, {key} AS row_key, '{metric}' AS metric, CAST({number} AS DOUBLE) AS value, "
                f"CAST({text} AS VARCHAR) AS value_text FROM ({source}) x")

    asset = "COALESCE(asset_type, '')"
    out = [cell("general_metrics", _GENERAL, "''", m, m) for m in _MEASURES]
    out.append(cell("trend_month", _trend("month"), "CAST(period AS VARCHAR) || '/' || COALESCE(tx_type, '')", "total_amount",
                    "total_amount"))
    out += [cell("asset_metrics", "SELECT * FROM asset_row", asset, m, m) for m in _ASSET_COLUMNS if m != "asset_type"]
    out.append(cell("users_by_asset_type", _HEADS, asset, "total_users", "total_users"))
    person = "COALESCE(user_id, '') || '/' || COALESCE(employment_status, '')"
    out.append(cell("user_clean", "SELECT * FROM grouped", person, "age", "age"))
    shown = {c: c for c in ("gender", "country", "dob", "status", "use_option", "is_recent", "is_active", "age_group")}
    shown["created_at"] = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"
    out += [cell("user_clean", "SELECT * FROM grouped", person, m, text=e) for m, e in shown.items()]
    out += [cell("user_kpis", _KPIS, "''", m, m) for m in ("registered_users", "active_users", "users_with_most_recent_activity")]
    out.append(cell("dist_age_group", _AGES, "age_group", "count", "count"))
    out += [cell(key, _counted(column), column, "count", "count") for key, column in dists.items()]
    return out


def oracle_sql(inline_fixtures: bool = True) -> dict[str, str]:
    """Oracle SQL per key; with ``inline_fixtures=False`` the statements read tables named
    fx_transactions, fx_users, ... directly."""
    def over(views: list[str], ctes: list[str], select: str) -> str:
        parts = [duckdb_prelude(views)] if inline_fixtures else []
        text = ",\n".join([*parts, *ctes])
        lead = "" if inline_fixtures or not ctes else "WITH "
        # A select that opens with more relations of its own continues the list.
        more = select.lstrip().startswith(("within AS", "card AS"))
        return f"{lead}{text}{',' if more and text else ''}\n{select}"

    def rows(select: str, *ctes: str) -> str:
        return over(_LEDGER_VIEWS, [_PAIR, _ENTRY, *ctes], select)

    def assets(select: str) -> str:
        return rows(select, _HOLDING, _RATES, _ASSET_ROWS)

    def people(select: str, *ctes: str) -> str:
        return over(_USER_VIEWS, [_PAIR, _ENTRY, _SEEN, _COHORT, *ctes], select)

    columns = ", ".join(_ASSET_COLUMNS)
    q = {
        "general_metrics": rows(_GENERAL, _PLATFORM),
        "date_presets": rows(_PRESET_ROWS, _PLATFORM, _PRESETS),
        "trend_pivot": rows(_PIVOT),
        "trend_pivot_present": rows(_PIVOT_PRESENT),
        "asset_metrics": assets(f"SELECT {columns} FROM asset_row"),
        "asset_revenue": assets("SELECT asset_type, estimated_revenue FROM asset_row"),
        "asset_fees": assets("SELECT asset_type, maintenance_fees_ghs, early_withdrawal_fees_usd FROM asset_row"),
        "asset_detail": assets(f"SELECT {columns}, total_users FROM asset_row WHERE asset_type = 'equity'"),
        "users_by_asset_type": assets(_HEADS),
        "user_counts": over(["fx_users"], [], _SIGNED_UP),
        "asset_types": rows(_TYPES),
        "asset_type_count": rows(f"SELECT COUNT(*) AS asset_type_count FROM ({_TYPES}) x"),
        "user_insights": people("SELECT * FROM cohort"),
        "active_users": people("SELECT DISTINCT who AS user_id FROM seen"),
        "recent_users": over(["fx_users"], [], "SELECT CAST(id AS VARCHAR) AS user_id FROM fx_users "
                                               f"WHERE CAST(most_recent_activity AS DATE) {_DAY}"),
        "user_kpis": people(_KPIS),
        "user_clean": people("SELECT * FROM grouped", _TIDY),
        "dist_age_group": people(_AGES, _TIDY),
        "kpi_general": rows(_cards(_GENERAL_CARDS, "general_row CROSS JOIN sign_ups"), _PLATFORM,
                            f"general_row AS ({_GENERAL})", f"sign_ups AS ({_SIGNED_UP})"),
        "kpi_asset": assets(_cards(_ASSET_CARDS, "asset_row WHERE asset_type IS NOT NULL", "asset_type")),
        "kpi_user": people(_cards(_USER_CARDS, "user_row"), f"user_row AS ({_KPIS})"),
        "ledger_base": rows("SELECT customer AS customer_id, customer_name, entry_id AS transaction_id, "
                            "kind AS transaction_type, moment AS transaction_date, ghs AS ghs_amount, "
                            "usd AS usd_amount, provider AS pn FROM entry WHERE free"),
        "depositors_summary": rows(_deposits("platform", "customer AS customer_id"), _PLATFORM),
        "depositors_by_asset": rows(_deposits("holding", "customer AS customer_id, asset AS asset_type"), _HOLDING),
        "first_transactions": rows(_FIRST),
        "ledger_cohorts": rows(_COHORTS),
    }
    for grain in ("day", "week", "month"):
        q[f"trend_{grain}"] = rows(_trend(grain))
    formats = "['%Y-%m-%d', '%d/%m/%Y', '%d-%m-%Y', '%d.%m.%Y', '%Y%m%d', '%Y/%m/%d', '%B %d, %Y', '%d %b %Y']"
    if inline_fixtures:
        q["birth_dates_spelled"] = over(["fx_spelled"], [], f"""SELECT user_id, dob AS dob_text, CAST(day AS DATE) AS dob,
  CAST(2024 - year(day) AS INTEGER) AS age,
  CASE WHEN 2024 - year(day) BETWEEN 18 AND 77 THEN format('[{{}}, {{}})', 18 + 5 * ((2024 - year(day) - 18) // 5),
       23 + 5 * ((2024 - year(day) - 18) // 5)) END AS age_group
FROM (SELECT *, try_strptime(trim(dob), {formats}) AS day FROM fx_spelled) x""")
    # A ledger appended in batches gives what it gives at once.
    q |= {"general_metrics_batches": q["general_metrics"], "trend_week_batches": q["trend_week"],
          "trend_month_stored": q["trend_month"], "ledger_base_stored": q["ledger_base"],
          "depositors_batches": q["depositors_summary"], "first_transactions_batches": q["first_transactions"]}
    dists = {"dist_gender": "gender", "dist_country": "country", "dist_use_option": "use_option",
             "dist_status": "status", "dist_employment": "employment_status"}
    for key, column in dists.items():
        q[key] = people(_counted(column), _TIDY)
    stored = {"general_metrics": _GENERAL, "trend_month": _trend("month"), "asset_metrics": "SELECT * FROM asset_row",
              "users_by_asset_type": _HEADS, "user_clean": "SELECT * FROM grouped", "user_kpis": _KPIS,
              "dist_age_group": _AGES, **{key: _counted(column) for key, column in dists.items()}}
    q["report_mart"] = people("\nUNION ALL ".join(
        f"SELECT '{name}' AS table_name, DATE '2024-01-05' AS window_start, DATE '2024-01-20' AS window_end, "
        f"COUNT(*) AS row_count FROM ({select}) x" for name, select in stored.items()),
        _TIDY, _PLATFORM, _HOLDING, _RATES, _ASSET_ROWS)
    q["mart_contents"] = people("\nUNION ALL ".join(_mart_cells(dists)), _TIDY, _PLATFORM, _HOLDING, _RATES, _ASSET_ROWS)
    return q

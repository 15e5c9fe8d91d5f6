"""Fixture ledger built from the driver's read-only test tables.

The ledger's nine tables do not exist as files; they are views over
``events``, ``customer`` and ``nation`` (see FIXTURES.md).  Each view is one
SQL text with ``{name}`` placeholders for the relations it reads:

* Spark fills the placeholders with DataFrames (``spark.sql(text, name=df)``),
  so no temporary view is registered in the session;
* the DuckDB oracle fills them with plain names and inlines the texts as CTEs.

Both engines therefore read the same rows.  Literal braces are doubled.
"""

from __future__ import annotations

# The view texts of FIXTURES.md, in dependency order.
VIEW_SQL: dict[str, str] = {
    "fx_activity": """
SELECT event_id, ts, event_type, value, props,
  user_id * 10 + CASE WHEN h < 50 THEN 0 WHEN h < 80 THEN 1 WHEN h < 92 THEN 2 WHEN h < 96 THEN 3
                      WHEN h < 98 THEN 4 WHEN h < 99 THEN 5 ELSE 6 END AS user_key
FROM (SELECT *, CAST(FLOOR(event_id / 4e0) AS BIGINT) % 100 AS h FROM {events}) e
""",
    "fx_transactions": """
SELECT event_id AS id,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 4 IN (0, 1, 3) THEN user_key END AS plan_id,
  CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 4 = 2 THEN 1000000 + user_key
       WHEN event_id % 4 = 3 THEN 1000001 + user_key END AS investment_plan_id,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN 'refund' ELSE
       CASE event_type WHEN 'click' THEN 'deposit' WHEN 'purchase' THEN 'withdrawal'
       WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'direct_debit' ELSE 'deposit' END
       ELSE CASE WHEN event_id % 3 = 0 THEN 'early_withdrawal' ELSE 'deposit' END END END AS tx_type,
  CASE WHEN event_id % 13 = 0 THEN 'Flex Dollar' WHEN event_id % 13 = 5 THEN NULL ELSE 'provider_a' END AS provider_number,
  CASE WHEN event_id % 37 = 0 THEN '{{"note": "MONTHLY maintenance FEE deduction"}}' ELSE props END AS metadata,
  ts AS updated_at, CAST(value AS DECIMAL(18,2)) AS amount, CAST(value * 2 AS DECIMAL(18,2)) AS usd_amount,
  CAST(10 + event_id % 7 AS DECIMAL(18,6)) AS exchange_rate
FROM {fx_activity}
""",
    "fx_users": """
SELECT c.c_custkey AS id, 'Customer' || CAST(c.c_custkey % 5 AS VARCHAR(10)) AS first_name,
  CASE WHEN c.c_custkey % 50 = 7 THEN NULL ELSE SUBSTR(c.c_name, 10) END AS last_name,
  (c.c_custkey % 11 = 3) AS restricted, e.created_at, e.updated_at, e.most_recent_activity,
  CASE WHEN c.c_custkey % 3 = 0 THEN '{{"kyc":"KYC_Completed"}}' ELSE '{{}}' END AS metadata,
  CASE c.c_custkey % 6 WHEN 0 THEN CHR(9) || ' Male' || CHR(10) WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'non binary'
       WHEN 3 THEN 'Non-Binary' WHEN 4 THEN 'male' END AS gender,
  CASE WHEN c.c_custkey % 2 = 0 THEN ' Country_' ELSE 'Country_' END || CAST(c.c_nationkey AS VARCHAR(10)) || ' ' AS country,
  CASE WHEN c.c_custkey % 17 = 0 THEN 'n/a' WHEN c.c_custkey % 19 = 0 THEN NULL
       ELSE CAST(1935 + c.c_custkey % 80 AS VARCHAR(10)) || '-06-15' END AS dob,
  CASE c.c_custkey % 3 WHEN 0 THEN 'KYC_verifeid' WHEN 1 THEN ' kyc_verified' ELSE 'Pending' END AS status,
  CASE c.c_custkey % 4 WHEN 0 THEN 'Investment' WHEN 1 THEN 'investments ' WHEN 2 THEN 'Savings' END AS use_option
FROM {customer} c LEFT JOIN (
  SELECT user_key, MIN(CASE WHEN event_type = 'error' THEN ts END) AS created_at,
    MAX(CASE WHEN event_type = 'view' THEN ts END) AS updated_at,
    MAX(CASE WHEN event_id % 9 = 0 THEN ts END) AS most_recent_activity
  FROM {fx_activity} GROUP BY user_key) e ON e.user_key = c.c_custkey
""",
    "fx_plans": """
SELECT c_custkey AS id, c_custkey AS user_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'savings_usd_a' ELSE 'savings_usd_b' END AS plan_option
FROM {customer}
""",
    "fx_investment_plans": """
SELECT 1000000 + c_custkey AS id, c_custkey AS user_id, c_custkey % 27 AS asset_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'fixed' ELSE 'flexible' END AS plan_option, DATE '2024-06-30' + CAST(c_custkey % 90 AS INT) AS maturity_date
FROM {customer}
""",
    "fx_assets": """
SELECT CAST(n_nationkey AS BIGINT) AS id,
  CASE n_nationkey WHEN 0 THEN 'spread_trade' WHEN 1 THEN 'equity' WHEN 2 THEN 'fund' WHEN 3 THEN 'etf'
       WHEN 4 THEN 'fixed_income' WHEN 5 THEN 'savings_usd_c' WHEN 6 THEN 'credit_fund'
       ELSE 'unpriced' END AS name, DATE '2024-12-31' + CAST(n_nationkey AS INT) AS maturity_date
FROM {nation}
""",
    "fx_profiles": """
SELECT c_custkey AS user_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS employment_status FROM {customer}
UNION ALL SELECT c_custkey, 'Second job' FROM {customer} WHERE c_custkey % 23 = 1
""",
    "fx_budgets": """
SELECT user_key AS user_id, ts AS created_at FROM {fx_activity} WHERE event_type = 'signup'
""",
    "fx_external_transactions": """
SELECT user_key AS user_id, ts AS created_at FROM {fx_activity} WHERE event_type = 'purchase'
""",
    "fx_messages": """
SELECT CAST(user_key AS VARCHAR(20)) AS user_ref, ts AS created_at FROM {fx_activity} WHERE event_type = 'view'
""",
    "fx_spelled": """
SELECT c_custkey AS user_id,
  CASE c_custkey % 8 WHEN 0 THEN y || '-' || mm || '-' || dd WHEN 1 THEN dd || '/' || mm || '/' || y
       WHEN 2 THEN dd || '-' || mm || '-' || y WHEN 3 THEN dd || '.' || mm || '.' || y WHEN 4 THEN y || mm || dd
       WHEN 5 THEN y || '/' || mm || '/' || dd WHEN 6 THEN ' ' || month_name || ' ' || CAST(d AS VARCHAR(2)) || ', ' || y
       ELSE CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE dd || ' ' || SUBSTR(month_name, 1, 3) || ' ' || y END END AS dob
FROM (SELECT c_custkey, CAST(1940 + c_custkey % 70 AS VARCHAR(4)) AS y, 1 + c_custkey % 28 AS d,
        LPAD(CAST(1 + c_custkey % 12 AS VARCHAR(2)), 2, '0') AS mm, LPAD(CAST(1 + c_custkey % 28 AS VARCHAR(2)), 2, '0') AS dd,
        CASE c_custkey % 12 WHEN 0 THEN 'January' WHEN 1 THEN 'February' WHEN 2 THEN 'March' WHEN 3 THEN 'April'
             WHEN 4 THEN 'May' WHEN 5 THEN 'June' WHEN 6 THEN 'July' WHEN 7 THEN 'August' WHEN 8 THEN 'September'
             WHEN 9 THEN 'October' WHEN 10 THEN 'November' ELSE 'December' END AS month_name
      FROM {customer}) c
""",
}

SOURCE_TABLES = ("events", "customer", "nation")


def _inputs(name: str) -> list[str]:
    text = VIEW_SQL[name]
    return [n for n in (*SOURCE_TABLES, *VIEW_SQL) if "{" + n + "}" in text]


def view_closure(names) -> list[str]:
    """The fixture views ``names`` read, with their inputs, in dependency order."""
    wanted: set[str] = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n in VIEW_SQL and n not in wanted:
            wanted.add(n)
            stack.extend(_inputs(n))
    return [n for n in VIEW_SQL if n in wanted]


def view_sources(name: str) -> list[str]:
    """The source tables that a fixture view reads, itself or through others."""
    return [n for n in SOURCE_TABLES if any(n in _inputs(v) for v in view_closure([name]))]


def duckdb_prelude(names) -> str:
    """``WITH`` clause defining the fixture views ``names`` for DuckDB."""
    parts = []
    for n in view_closure(names):
        body = VIEW_SQL[n].format(**{k: k for k in (*SOURCE_TABLES, *VIEW_SQL)})
        parts.append(f"{n} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts)


def spark_views(spark, sf_dir: str) -> dict:
    """All fixture views as lazy Spark DataFrames over ``sf_dir``'s Parquet."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCE_TABLES}
    for n, text in VIEW_SQL.items():
        frames[n] = spark.sql(text, **{k: frames[k] for k in _inputs(n)})
    return frames

"""Small fixed tables the jobs join against, and how to turn them into
DataFrames.  All of them are bounded by construction (they come from the
literals below, or from a rule with a fixed number of rows), so they are the
only relations this package broadcasts without measuring first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Transaction classes.
DEPOSIT_TYPES_PLATFORM = ("deposit", "direct_debit")   # general metrics
DEPOSIT_TYPES_ASSET = ("deposit",)                     # per-asset metrics
WITHDRAWAL_TYPE = "withdrawal"
FEE_TYPE = "maintenance_fee"
EARLY_WITHDRAWAL_TYPE = "early_withdrawal"
EXCLUDED_PROVIDER = "Flex Dollar"
FEE_TEXT_PATTERN = "%Monthly maintenance fee deduction%"   # matched case-insensitively
KYC_TEXT_PATTERN = "%kyc_completed%"                       # matched case-insensitively
EARLY_WITHDRAWAL_FEE_RATE = "0.025"                        # exact decimal
TREND_TYPES = ("deposit", "withdrawal", "direct_debit", "early_withdrawal")
TREND_RENAMES = {"deposit": "Deposits", "withdrawal": "Withdrawals"}
TREND_OTHER = "Other"                                      # every other type, and a missing one

# ---------------------------------------------------------------------------
# Fee schedule for the fixture's asset types (FIXTURES.md).
# (asset_type, monthly rate, money column, withdrawals included)
# A deployment passes its own table with the same four columns.
FIXTURE_FEES = (
    ("spread_trade", 0.01, "ghs", True),
    ("savings_usd_a", 0.0475 / 12, "usd", False),
    ("savings_usd_b", 0.06 / 12, "usd", False),
    ("savings_usd_c", 0.06 / 12, "usd", False),
    ("credit_fund", 0.04 / 12, "usd", False),
    ("fixed_income", 0.02 / 12, "usd", False),
    ("equity", 0.02, "ghs", False),
    ("fund", 0.02, "ghs", False),
    ("etf", 0.02, "usd", False),
)

FEE_SCHEMA = T.StructType([
    T.StructField("asset_type", T.StringType(), False),
    T.StructField("rate", T.DoubleType(), False),
    T.StructField("money", T.StringType(), False),
    T.StructField("include_withdrawals", T.BooleanType(), False),
])

# ---------------------------------------------------------------------------
# Metric explanations shown on the KPI cards.
METRIC_EXPLANATIONS = {
    "deposit_value_ghs": "Total amount deposited by customers in Ghana Cedis during the selected period",
    "deposit_value_usd": "Total amount deposited by customers in US Dollars during the selected period",
    "deposit_count": "Number of successful deposit transactions completed during the selected period",
    "withdrawal_value_ghs": "Total amount withdrawn by customers in Ghana Cedis during the selected period",
    "withdrawal_value_usd": "Total amount withdrawn by customers in US Dollars during the selected period",
    "withdrawal_count": "Number of successful withdrawal transactions completed during the selected period",
    "aum_ghs": "Assets Under Management - Net amount (Deposits minus Withdrawals) in Ghana Cedis",
    "aum_usd": "Assets Under Management - Net amount (Deposits minus Withdrawals) in US Dollars",
    "total_depositors": "Number of unique customers who made at least one deposit during the period",
    "new_depositors": "Customers making their very first deposit during the selected period",
    "recurring_depositors": "Customers who have made deposits on multiple different days (repeat customers)",
    "total_withdrawers": "Number of unique customers who made at least one withdrawal during the period",
    "avg_deposit_value_ghs": "Average amount per deposit transaction in Ghana Cedis",
    "avg_deposit_value_usd": "Average amount per deposit transaction in US Dollars",
    "avg_withdrawal_value_ghs": "Average amount per withdrawal transaction in Ghana Cedis",
    "avg_withdrawal_value_usd": "Average amount per withdrawal transaction in US Dollars",
    "estimated_revenue": "Calculated revenue based on asset-specific fee structures and transaction volumes",
    "registered_users": "Number of user registrations/signups during the selected period",
    "kyc_users": "Total number of users who have completed KYC verification (all time)",
    "asset_type_count": "Number of different asset types with transactions during the period",
    "total_users": "Number of users with asset type during the period",
    "active_users": "Number of users who have made at least one transaction (deposit or withdrawal) or used the spending feature during the period",
    "users_with_most_recent_activity": "Users who have had any form of activity on the app",
}

# KPI cards, in page order.
# (metric, label, format: "money" | "int", currency prefix)
GENERAL_CARDS = (
    ("deposit_value_ghs", "Total Deposits (GHS)", "money", "₵"),
    ("deposit_value_usd", "Total Deposits (USD)", "money", "$"),
    ("deposit_count", "Total Deposits Count", "int", ""),
    ("withdrawal_value_ghs", "Total Withdrawals (GHS)", "money", "₵"),
    ("withdrawal_value_usd", "Total Withdrawals (USD)", "money", "$"),
    ("withdrawal_count", "Total Withdrawals Count", "int", ""),
    ("aum_ghs", "Assets Under Management (AUM) GHS", "money", "₵"),
    ("aum_usd", "Assets Under Management (AUM) USD", "money", "$"),
    ("new_depositors", "New Depositors", "int", ""),
    ("recurring_depositors", "Recurring Depositors", "int", ""),
    ("registered_users", "Registered Users", "int", ""),
    ("kyc_users", "KYC Verified Users", "int", ""),
)

ASSET_CARDS = (
    ("deposit_value_ghs", "Total Deposits (GHS)", "money", "₵"),
    ("deposit_value_usd", "Total Deposits (USD)", "money", "$"),
    ("deposit_count", "📥 Deposit Count", "int", ""),
    ("withdrawal_value_ghs", "💸 Withdrawal (GHS)", "money", "₵"),
    ("withdrawal_value_usd", "Withdrawal (USD)", "money", "$"),
    ("withdrawal_count", "📥 Total Withdrawals Count", "int", ""),
    ("aum_ghs", "📊 AUM (GHS)", "money", ""),
    ("aum_usd", "📊 AUM (USD)", "money", ""),
    ("total_depositors", "👥 Total Depositors", "int", ""),
    ("new_depositors", "🆕 New Depositors", "int", ""),
    ("recurring_depositors", "🔁 Recurring Depositors", "int", ""),
    ("avg_deposit_value_ghs", "💰 Avg Deposit (GHS)", "money", ""),
    ("avg_deposit_value_usd", "💰 Avg Deposit (USD)", "money", ""),
    ("avg_withdrawal_value_ghs", "💸 Avg Withdrawal (GHS)", "money", ""),
    ("avg_withdrawal_value_usd", "💸 Avg Withdrawal (USD)", "money", ""),
    ("estimated_revenue", "💰 Estimated Revenue", "money", ""),
    ("total_users", "👥 Total Users", "int", ""),
)

USER_CARDS = (
    ("registered_users", "🧍 Total Registered Users"),
    ("active_users", "🟢 Active Users"),
    ("users_with_most_recent_activity", "👤 Users With Recent Activity"),
)

# ---------------------------------------------------------------------------
# Demographic clean-up (applied after trim + lower-case).
GENDER_ALIASES = {"non binary": "non-binary", "non-binary": "non-binary",
                  "female": "female", "male": "male"}
USE_OPTION_ALIASES = {"investment": "investments", "investments": "investments"}
STATUS_ALIASES = {"kyc_verifeid": "kyc_verified"}

# Age bins are left-closed, 5 years wide, from 18 up to 78.
AGE_BIN_FIRST, AGE_BIN_WIDTH, AGE_BIN_COUNT = 18, 5, 12


# ---------------------------------------------------------------------------
_SMALL: dict = {}


def small_table(spark: SparkSession, key, build) -> DataFrame:
    """A constant table, created once per Spark application."""
    k = (spark.sparkContext.applicationId, key)
    if k not in _SMALL:
        _SMALL[k] = build()
    return _SMALL[k]


def fee_table(spark: SparkSession, rows=FIXTURE_FEES) -> DataFrame:
    rows = tuple(rows)
    return small_table(spark, ("fees", rows),
                       lambda: spark.createDataFrame(list(rows), FEE_SCHEMA))


def card_table(spark: SparkSession, cards) -> DataFrame:
    rows = [(i, metric, label, fmt, prefix, METRIC_EXPLANATIONS[metric])
            for i, (metric, label, fmt, prefix) in enumerate(cards, start=1)]
    return small_table(spark, ("cards", tuple(cards)), lambda: spark.createDataFrame(
        rows, "card_order int, metric string, label string, value_format string, "
              "prefix string, explanation string"))


def age_bins(spark: SparkSession) -> DataFrame:
    """The twelve age bins ``[lo, hi)`` with their text labels, generated."""
    return small_table(spark, ("age_bins",), lambda: _age_bins(spark))


def _age_bins(spark: SparkSession) -> DataFrame:
    lo = F.lit(AGE_BIN_FIRST) + F.col("id").cast("int") * AGE_BIN_WIDTH
    hi = lo + AGE_BIN_WIDTH
    return (spark.range(AGE_BIN_COUNT)
            .select(F.col("id").cast("int").alias("age_bin"), lo.alias("bin_lo"),
                    hi.alias("bin_hi"))
            .withColumn("age_group", F.concat(F.lit("["), F.col("bin_lo").cast("string"),
                                              F.lit(", "), F.col("bin_hi").cast("string"),
                                              F.lit(")"))))

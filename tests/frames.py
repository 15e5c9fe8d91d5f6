"""Small hand-made ledgers for trap tests (schemas as FIXTURES.md)."""

import datetime as dt
from decimal import Decimal

from ledgerscope import reference_data as rd
from ledgerscope.sources.tables import LedgerTables

SCHEMAS = {
    "transactions": "id bigint, plan_id bigint, investment_plan_id bigint, status string, "
                    "tx_type string, provider_number string, metadata string, "
                    "updated_at timestamp_ntz, amount decimal(18,2), usd_amount decimal(18,2), "
                    "exchange_rate decimal(18,6)",
    "users": "id bigint, first_name string, last_name string, restricted boolean, "
             "created_at timestamp_ntz, updated_at timestamp_ntz, "
             "most_recent_activity timestamp_ntz, metadata string, gender string, "
             "country string, dob string, status string, use_option string",
    "plans": "id bigint, user_id bigint, plan_option string",
    "investment_plans": "id bigint, user_id bigint, asset_id bigint, plan_option string, "
                        "maturity_date date",
    "assets": "id bigint, name string, maturity_date date",
    "profiles": "user_id bigint, employment_status string",
    "budgets": "user_id bigint, created_at timestamp_ntz",
    "external_transactions": "user_id bigint, created_at timestamp_ntz",
    "messages": "user_ref string, created_at timestamp_ntz",
}


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def tx(id, ts_, amount, tx_type="deposit", plan_id=None, investment_plan_id=None,
       status="success", provider="provider_a", metadata="{}", usd=None):
    a = Decimal(str(amount))
    u = Decimal(str(usd)) if usd is not None else a * 2
    return (id, plan_id, investment_plan_id, status, tx_type, provider, metadata, ts(ts_),
            a, u, Decimal("12.5"))


def user(id, restricted=False, created_at=None, updated_at=None, recent=None,
         metadata="{}", gender=None, country=None, dob=None, status=None, use_option=None,
         last_name="X"):
    c = ts(created_at) if created_at else None
    return (id, "Customer", last_name, restricted, c, ts(updated_at) if updated_at else None,
            ts(recent) if recent else None, metadata, gender, country, dob, status, use_option)


def ledger_tables(spark, **rows) -> LedgerTables:
    frames = {name: spark.createDataFrame(rows.get(name, []), schema)
              for name, schema in SCHEMAS.items()}
    return LedgerTables(**frames, fees=rd.fee_table(spark))

"""Presentation data (J14) and the report mart.

KPI cards are data, not HTML: each metric of a result row becomes one row
``card_order, metric, label, value, display_value, explanation``.  The wide
result is unpivoted and joined to the card table, which is a fixed literal
and therefore broadcast.

The mart writes a window's platform metrics, monthly trend, asset metrics,
users per asset type and user page to Parquet, partitioned by window, with
dynamic partition overwrite: re-running a window (or a retried task) replaces
exactly that window's files.  Without a given root every run has a folder of
its own under the shared folder, so two inputs, or two runs, never meet.  The
manifest (tables and row counts) is written last; what has none is unfinished.

``reused`` and ``mart_tables`` look a result up before computing it (``results.ResultStore``):
asked again over unchanged files, they read what an earlier run stored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DateType, StructField, StructType

from ledgerscope import reference_data as rd
from ledgerscope.functions import formatting
from ledgerscope.functions.periods import Window
from ledgerscope.operators import ledger, metrics, trend, users
from ledgerscope.operators.results import ResultStore, Save
from ledgerscope.session import shared_dir
from ledgerscope.sources.tables import LedgerTables

CARD_COLUMNS = ["card_order", "metric", "label", "value", "display_value", "explanation",
                "period_label"]


def _long(wide: DataFrame, ids: list[str], metric_names: list[str]) -> DataFrame:
    values = wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metric_names])
    return values.unpivot(ids, metric_names, "metric", "value")


def _cards(long: DataFrame, cards, ids: list[str]) -> DataFrame:
    table = F.broadcast(rd.card_table(long.sparkSession, cards))
    return (long.join(table, "metric")
            .select(*ids, "card_order", "metric", "label", "value",
                    formatting.card_value(F.col("value"), F.col("value_format"),
                                          F.col("prefix")).alias("display_value"),
                    "explanation"))


def kpi_general(t: LedgerTables, window: Window) -> DataFrame:
    """J14, general page: twelve cards from J1 and J5."""
    names = [m for m, *_ in rd.GENERAL_CARDS]
    g = metrics.general_metrics(t, window)
    u = metrics.user_counts(t, window)
    long = (_long(g, [], [m for m in names if m in g.columns])
            .unionByName(_long(u, [], [m for m in names if m in u.columns])))
    return (_cards(long, rd.GENERAL_CARDS, [])
            .withColumn("period_label", formatting.period_label(window.start, window.end))
            .orderBy("card_order"))


def kpi_asset(t: LedgerTables, window: Window, fees: DataFrame | None = None) -> DataFrame:
    """J14, asset page: per asset type, sixteen cards from J4 plus the J6
    user count (that card only when J6 has the type)."""
    names = [m for m, *_ in rd.ASSET_CARDS]
    # J4 and J6 from one pass over the ledger
    wide = metrics.asset_rollup(t, window, fees).filter(F.col("asset_type").isNotNull())
    long = (_long(wide, ["asset_type"], names)
            .filter((F.col("metric") != "total_users") | F.col("value").isNotNull()))
    return (_cards(long, rd.ASSET_CARDS, ["asset_type"])
            .withColumn("period_label", formatting.period_label(window.start, window.end))
            .orderBy("asset_type", "card_order"))


def kpi_user(t: LedgerTables, window: Window) -> DataFrame:
    """J14, user page: three cards from J9, shown as plain integers."""
    k = users.user_kpis(t, window)
    names = [m for m, _ in rd.USER_CARDS]
    long = _long(k, [], names)
    cards = [(m, label, "plain", "") for m, label in rd.USER_CARDS]
    table = F.broadcast(rd.card_table(t.spark, cards))
    return (long.join(table, "metric")
            .select("card_order", "metric", "label", "value",
                    F.col("value").cast("bigint").cast("string").alias("display_value"),
                    "explanation",
                    formatting.period_label(window.start, window.end).alias("period_label"))
            .orderBy("card_order"))


MART_TABLES = ("general_metrics", "trend_month", "asset_metrics", "users_by_asset_type",
               "user_clean", "user_kpis", "dist_gender", "dist_country", "dist_use_option",
               "dist_status", "dist_employment", "dist_age_group")

MANIFEST = "manifest"

_DIST_TABLES = {"dist_gender": "gender", "dist_country": "country",
                "dist_use_option": "use_option", "dist_status": "status",
                "dist_employment": "employment_status"}


def _write(df: DataFrame, root: str, name: str, window: Window) -> None:
    (df.withColumn("window_start", F.lit(window.start))
       .withColumn("window_end", F.lit(window.end))
       .write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("window_start", "window_end")
       .parquet(f"{root}/{name}"))


def read_report_mart(spark, root: str, name: str, window: Window, schema=None) -> DataFrame:
    """One mart table for one window (partition-pruned read); with its ``schema`` also
    one of no rows, which has no file to tell it."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField("window_start", DateType()),
                                           StructField("window_end", DateType())]))
    return (reader.parquet(f"{root}/{name}")
            .filter((F.col("window_start") == F.lit(window.start))
                    & (F.col("window_end") == F.lit(window.end)))
            .drop("window_start", "window_end"))


def write_deposit_bounds(t: LedgerTables, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Store the lifetime deposit bounds (platform; per asset type) under the
    shared folder, with the state of the source they were built from, and
    return them read back.  Window jobs given these read only their window's
    rows; ``ledger.merge_deposit_bounds`` folds in an appended batch."""
    root = root or f"{shared_dir(t.spark)}/deposit_bounds"
    state = source_state(t)
    ledger.general_deposit_bounds(t).write.mode("overwrite").parquet(f"{root}/general")
    ledger.asset_deposit_bounds(t).write.mode("overwrite").parquet(f"{root}/asset")
    t.spark.createDataFrame([state], _STATE).write.mode("overwrite").parquet(f"{root}/state")
    return (t.spark.read.parquet(f"{root}/general"), t.spark.read.parquet(f"{root}/asset"))


_STATE = "transactions long, latest timestamp_ntz, standing decimal(38,0), users decimal(38,0)"


def source_state(t: LedgerTables) -> tuple:
    """What stored bounds depend on: number and last instant of the
    transactions, a sum over their ids, statuses and instants, and one over
    users' restriction flags.  Two aggregates of one row each; the columns
    read are four of the transactions' and two of the users'."""
    whole = lambda *cols: F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
    tx = t.transactions.agg(F.count(F.lit(1)), F.max("updated_at"), whole("id", "status", "updated_at")).first()
    people = t.users.agg(whole("id", "restricted")).first()
    return (tx[0], tx[1], tx[2], people[0])


def read_deposit_bounds(t: LedgerTables, root: str) -> tuple[DataFrame, DataFrame] | None:
    """The stored bounds under ``root``; None if there are none.

    Raises when the source's state has changed since they were built: a
    bound can't be taken back, so a changed status, instant or restriction
    needs them rebuilt (for appended rows, merged)."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/state")
    if not path.getFileSystem(t.spark._jsc.hadoopConfiguration()).exists(path):
        return None
    if tuple(t.spark.read.parquet(f"{root}/state").first()) != source_state(t):
        raise ValueError(f"the deposit bounds in {root} are stale: the ledger has changed; rebuild them")
    return (t.spark.read.parquet(f"{root}/general"), t.spark.read.parquet(f"{root}/asset"))


def _mart(t: LedgerTables, window: Window, as_of, save: Save, bounds=None, fees: DataFrame | None = None) -> None:
    """The mart's tables, each saved once; what derives from another is computed from the saved one."""
    gen_bounds, asset_bounds = bounds or (None, None)
    save("general_metrics", metrics.general_metrics(t, window, bounds=gen_bounds))
    save("trend_month", trend.transaction_trend(t, window, "month"))
    assets = save("asset_rollup", metrics.asset_rollup(t, window, fees, bounds=asset_bounds).select(
        *metrics.ASSET_COLUMNS, "total_users"))
    clean = save("user_clean", users.user_clean(t, window, as_of))
    save("asset_metrics", assets.select(*metrics.ASSET_COLUMNS))
    save("users_by_asset_type", assets.filter("asset_type IS NOT NULL").select("asset_type", "total_users"))
    save("user_kpis", users.kpis_of(clean))
    save("dist_age_group", users.age_distribution_of(clean))
    for name, column in _DIST_TABLES.items():
        save(name, users.distribution_of(clean, column))


def write_report_mart(t: LedgerTables, window: Window, as_of, root: str | None = None,
                      bounds: tuple[DataFrame, DataFrame] | None = None,
                      fees: DataFrame | None = None) -> str:
    """Write one window's report tables and then their manifest; returns the root.

    J4 and J6 come from one pass over the ledger, stored once
    (``asset_rollup``) and split from there.  The user page is one cleaned user table (J10) written once; its KPIs and the six
    distributions are then computed from the stored table, so the cohort
    joins run once and a lost executor costs a re-read, not a recomputation.
    ``bounds`` (from ``write_deposit_bounds``) lets the platform and asset
    metrics read only the window's rows.
    """
    root = root or f"{shared_dir(t.spark)}/report_mart/{uuid.uuid4().hex}"
    schemas = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        _write(df, root, name, window)
        schemas[name] = df.schema
        return read_report_mart(t.spark, root, name, window, df.schema)

    _mart(t, window, as_of, save, bounds, fees)
    counts = [read_report_mart(t.spark, root, name, window, schemas[name])
              .agg(F.count(F.lit(1)).alias("row_count"))
              .select(F.lit(name).alias("table_name"), "row_count") for name in MART_TABLES]
    listed = counts[0]
    for one in counts[1:]:
        listed = listed.unionByName(one)
    _write(listed, root, MANIFEST, window)
    return root


def report_mart(t: LedgerTables, window: Window, as_of, root: str | None = None,
                bounds: tuple[DataFrame, DataFrame] | None = None,
                fees: DataFrame | None = None) -> DataFrame:
    """Write the mart, then its manifest for the window:
    ``table_name, window_start, window_end, row_count``."""
    root = write_report_mart(t, window, as_of, root, bounds, fees)
    return (read_report_mart(t.spark, root, MANIFEST, window)
            .select("table_name", F.lit(window.start).alias("window_start"),
                    F.lit(window.end).alias("window_end"), "row_count"))


_LEDGER = ("transactions", "plans", "investment_plans", "users")
_PEOPLE = (*_LEDGER, "profiles", "budgets", "external_transactions", "messages")

#: Job -> the logical tables that it reads, and the job over tables and arguments.
REUSABLE = {
    "general_metrics": (_LEDGER, metrics.general_metrics),
    "asset_metrics": ((*_LEDGER, "assets"), metrics.asset_metrics),
    "transaction_trend": (_LEDGER, trend.transaction_trend),
    "user_counts": (("users",), metrics.user_counts),
    "users_by_asset_type": ((*_LEDGER, "assets"), metrics.users_by_asset_type),
    "asset_types": ((*_LEDGER, "assets"), metrics.asset_types),
    "user_insights": (_PEOPLE, users.user_insights),
    "user_clean": (_PEOPLE, users.user_clean),
}


def reused(job: str, t: LedgerTables, *, store: ResultStore | None = None, **args) -> DataFrame:
    """The result of a job of ``REUSABLE``: an earlier one over the same files and arguments, else a new one, stored."""
    tables, compute = REUSABLE[job]
    store = store or ResultStore(t.spark)
    return store.reuse(job, args, t, lambda now, save: save(job, compute(now, **args)), tables)[job]


def mart_tables(t: LedgerTables, window: Window, as_of, store: ResultStore | None = None,
                fees: DataFrame | None = None) -> dict[str, DataFrame]:
    """J15's tables for a window, looked up or computed and stored."""
    found = (store or ResultStore(t.spark)).reuse(
        "report_mart", {"window": window, "as_of": as_of}, t,
        lambda now, save: _mart(now, window, as_of, save, fees=fees), fees=fees)
    return {name: found[name] for name in MART_TABLES}


def _cells(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a cell of ``df``: numbers in ``value``, other values as text in ``value_text``."""
    row_key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields if f.name not in keys}
    texts = [c for c, k in kinds.items() if k in ("string", "boolean", "date", "timestamp_ntz")]
    numbers = [c for c in kinds if c not in texts]

    def shown(c: str):
        return (F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kinds[c] == "timestamp_ntz" else F.col(c).cast("string")).alias(c)

    wide = df.select(row_key.alias("row_key"), *[F.col(c).cast("double").alias(c) for c in numbers], *[shown(c) for c in texts])
    parts = []
    if numbers:
        parts.append(wide.unpivot("row_key", numbers, "metric", "value").withColumn("value_text", F.lit(None).cast("string")))
    if texts:
        parts.append(wide.unpivot("row_key", texts, "metric", "value_text").withColumn("value", F.lit(None).cast("double")))
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return long.select(F.lit(name).alias("table_name"), "row_key", "metric", "value", "value_text")


#: Key columns of the mart's tables; a cell is known by table, key and column.
MART_KEYS = {"general_metrics": [], "trend_month": ["period", "tx_type"], "asset_metrics": ["asset_type"],
             "users_by_asset_type": ["asset_type"], "user_clean": ["user_id", "employment_status"], "user_kpis": [],
             "dist_age_group": ["age_group"], **{name: [column] for name, column in _DIST_TABLES.items()}}


def mart_contents(t: LedgerTables, window: Window, as_of, store: ResultStore | None = None,
                  fees: DataFrame | None = None) -> DataFrame:
    """Every cell of J15's tables, as stored: ``table_name, row_key, metric, value, value_text``."""
    found = mart_tables(t, window, as_of, store, fees)
    out = None
    for name in MART_TABLES:
        cells = _cells(name, found[name], MART_KEYS[name])
        out = cells if out is None else out.unionByName(cells)
    return out

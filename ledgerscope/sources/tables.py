"""Table registry: the nine ledger relations as one object of DataFrames.

Every job takes a ``LedgerTables``; where the rows come from (fixture views,
Parquet folders, a JDBC database) is decided here and nowhere else.

Column names follow the ledger schema (FIXTURES.md "Target schemas").  The
message table's quoted ``"user"`` column is renamed to ``user_ref`` on the
way in.  A source that spells another column differently (for example the
users' use-option column) is mapped with ``renames={"users": {"<source
name>": "use_option"}}``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ledgerscope import reference_data as rd
from ledgerscope.operators.joins import broadcast_byte_limit, broadcast_row_limit, measured_bytes
from ledgerscope.sources import files, fixtures

# logical name -> fixture view
FIXTURE_VIEWS = {
    "transactions": "fx_transactions",
    "users": "fx_users",
    "plans": "fx_plans",
    "investment_plans": "fx_investment_plans",
    "assets": "fx_assets",
    "profiles": "fx_profiles",
    "budgets": "fx_budgets",
    "external_transactions": "fx_external_transactions",
    "messages": "fx_messages",
}

# logical name -> table name in the production database
SOURCE_NAMES = {
    "transactions": "transactions",
    "users": "users",
    "plans": "plans",
    "investment_plans": "investment_plans",
    "assets": "assets",
    "profiles": "profiles",
    "budgets": "budgets",
    "external_transactions": "manual_and_external_transactions",
    "messages": "slack_message_dump",
}


#: Tables that the ledger may broadcast together.
DIMENSIONS = ("assets", "plans", "investment_plans", "users")


@dataclass(frozen=True)
class LedgerTables:
    transactions: DataFrame
    users: DataFrame
    plans: DataFrame
    investment_plans: DataFrame
    assets: DataFrame
    profiles: DataFrame
    budgets: DataFrame
    external_transactions: DataFrame
    messages: DataFrame
    #: Rate table of the asset metrics; without one a job must be given it.
    fees: DataFrame | None = None
    #: Where the rows lie: the Parquet paths by logical table. None for frames that are no files.
    paths: dict[str, tuple[str, ...]] | None = field(default=None, compare=False)
    #: Opens the same tables anew, as their files are then.
    reopen: Callable[[], LedgerTables] | None = field(default=None, compare=False, repr=False)
    _bounds: dict = field(default_factory=dict, compare=False, repr=False)
    _staged: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.transactions.sparkSession

    def is_small(self, name: str) -> bool:
        """Whether table ``name`` is broadcast.

        Of the dimensions that one job may broadcast together, the smallest
        are, as long as their bytes add up to the bound and each is within the
        row bound.  Rows are counted once per object (a Parquet count reads
        only file footers); the bytes of tables within the row bound are
        measured, texts included (``joins.measured_bytes``).
        """
        limits = broadcast_row_limit(self.spark), broadcast_byte_limit(self.spark)
        if limits not in self._bounds:
            within = [n for n in DIMENSIONS if self.rows(n) <= limits[0]]
            chosen, total = set(), 0
            for size, n in sorted((self._bytes(n), n) for n in within):
                total += size
                if total <= limits[1]:
                    chosen.add(n)
            self._bounds[limits] = chosen
        return name in self._bounds[limits]

    def with_transactions(self, rows: DataFrame) -> LedgerTables:
        """The same dimensions (and their checked sizes) with other transactions."""
        return replace(self, transactions=rows, paths=None, reopen=None, _staged={})

    def rows(self, name: str) -> int:
        """Rows of a table, counted once per object."""
        if name not in self._bounds:
            self._bounds[name] = getattr(self, name).count()
        return self._bounds[name]

    def _bytes(self, name: str) -> int:
        if (name, "bytes") not in self._bounds:
            self._bounds[name, "bytes"] = measured_bytes(getattr(self, name))
        return self._bounds[name, "bytes"]

    def staged(self, key, build):
        """A derived relation (e.g. the enriched ledger) built once per
        registry and shared, lazily, by every query that reads it."""
        key = (key, broadcast_row_limit(self.spark), broadcast_byte_limit(self.spark))
        if key not in self._staged:
            self._staged[key] = build()
        return self._staged[key]


_REGISTRY: dict = {}


def fixture_tables(spark: SparkSession, sf_dir: str) -> LedgerTables:
    """The fixture ledger over ``sf_dir``; built once per session and state of its files,
    so its lazy plans and dimension size checks are shared by all queries."""
    sources = {n: f"{sf_dir}/{n}.parquet" for n in fixtures.SOURCE_TABLES}
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    state = tuple(files.path_state(spark, p) for p in sources.values())
    if _REGISTRY.get(key, (None,))[0] != state:
        views = fixtures.spark_views(spark, sf_dir)
        paths = {k: tuple(sources[n] for n in fixtures.view_sources(v)) for k, v in FIXTURE_VIEWS.items()}
        _REGISTRY[key] = state, LedgerTables(**{k: views[v] for k, v in FIXTURE_VIEWS.items()}, fees=rd.fee_table(spark),
                                             paths=paths, reopen=lambda: fixture_tables(spark, sf_dir))
    return _REGISTRY[key][1]


def _renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def parquet_tables(spark: SparkSession, root: str,
                   renames: dict[str, dict[str, str]] | None = None,
                   fees: DataFrame | None = None) -> LedgerTables:
    """Ledger stored as one Parquet folder per table under ``root``, priced by ``fees``.

    Reads are lazy; each job's column pruning and date filters reach the scan.
    """
    renames = {"messages": {"user": "user_ref"}, **(renames or {})}
    frames = {}
    for logical, name in SOURCE_NAMES.items():
        df = spark.read.parquet(f"{root}/{name}")
        frames[logical] = _renamed(df, renames.get(logical, {}))
    return LedgerTables(**frames, fees=fees, paths={k: (f"{root}/{v}",) for k, v in SOURCE_NAMES.items()},
                        reopen=lambda: parquet_tables(spark, root, renames, fees))


def jdbc_tables(spark: SparkSession, url: str, properties: dict[str, str],
                partitioning: dict[str, dict] | None = None,
                renames: dict[str, dict[str, str]] | None = None,
                fees: DataFrame | None = None) -> LedgerTables:
    """Ledger read straight from the operational database over JDBC.

    ``partitioning`` maps a logical table to ``column / lowerBound /
    upperBound / numPartitions`` so large tables are read by many tasks in
    parallel instead of one; ``transactions`` must be among them.  The reads
    themselves are not exercised by the tests (no database here).
    """
    if "transactions" not in (partitioning or {}):
        raise ValueError("give a partitioning for 'transactions': one task would read the whole table")
    renames = {"messages": {"user": "user_ref"}, **(renames or {})}
    partitioning = partitioning or {}
    frames = {}
    for logical, name in SOURCE_NAMES.items():
        opts = partitioning.get(logical)
        if opts:
            df = spark.read.jdbc(url, name, properties=properties, **opts)
        else:
            df = spark.read.jdbc(url, name, properties=properties)
        frames[logical] = _renamed(df, renames.get(logical, {}))
    return LedgerTables(**frames, fees=fees)

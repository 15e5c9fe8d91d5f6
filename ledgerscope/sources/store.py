"""A ledger stored co-partitioned with its plans, for jobs whose dimensions are too large to broadcast.

Owner, asset and class of a transaction depend on its pair of plan ids alone.  The store holds

* ``ledger``: the successful transactions, classified (``operators.ledger.facts``), in a folder a month, bucketed and
  sorted by the pair;
* ``pairs``: every pair with its resolved attributes, bucketed and sorted likewise.

Bucket meets bucket, so the join of the two has no exchange on either side, and a window reads its months only.
A pair that holds a large part of the rows (``operators.joins.heavy_keys``) is dealt over several buckets by
a salt, and its row in ``pairs`` is repeated for each.

A run has folders of its own, and a manifest (``manifests/<n>.json``, published by a rename) says which
runs are current: a reader sees a whole store or the one before.  ``refresh_pairs`` resolves the pairs again when
plans, users or assets have changed, without touching the ledger.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.periods import Window
from ledgerscope.operators import trend
from ledgerscope.operators.joins import heavy_keys
from ledgerscope.operators.ledger import PAIR, by_pair, eligible, facts, provider_ok
from ledgerscope.session import shared_dir
from ledgerscope.sources import files
from ledgerscope.sources.tables import LedgerTables

BUCKETS = 64
KEYS = ["plan_key", "investment_key", "salt"]


def _keyed(rows: DataFrame) -> DataFrame:
    """The pair as texts, empty for none: plain equality joins them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.withColumns({"plan_key": text("plan_id"), "investment_key": text("investment_plan_id")})


def _spread(heavy, otherwise):
    """For the pairs of ``heavy`` how many salts they have, else ``otherwise``."""
    out = F.lit(otherwise)
    for pair, parts in heavy:
        out = F.when(F.concat("plan_key", F.lit("/"), "investment_key") == F.lit(pair), F.lit(parts)).otherwise(out)
    return out


@dataclass(frozen=True)
class LedgerStore:
    ledger: DataFrame
    pairs: DataFrame

    def rows(self, window: Window | None = None) -> DataFrame:
        """The enriched rows (as ``operators.ledger.ledger``), of the window's months and instants if one is given."""
        rows = self.ledger
        if window is not None:
            months = F.col("month").between(window.start.strftime("%Y-%m"), window.end.strftime("%Y-%m"))
            rows = rows.filter(months & window.ts_between("transaction_date"))
        return rows.drop("month").join(self.pairs.drop(*PAIR), KEYS, "left").drop(*KEYS)


def _table(run: str, kind: str) -> str:
    return f"ledgerscope_{kind}_{run}"


def _save(df: DataFrame, root: str, run: str, kind: str, buckets: int, by: list[str]) -> None:
    """``df`` bucketed by ``KEYS``.  Each bucket is written by one task a month at most, not by all tasks."""
    dealt = df.repartition(buckets, *[F.col(c) for c in KEYS])
    (dealt.write.format("parquet").partitionBy(*by).bucketBy(buckets, *KEYS).sortBy(*KEYS)
     .option("path", f"{root}/{kind}/{run}").saveAsTable(_table(run, kind)))


def _open(spark: SparkSession, root: str, run: str, kind: str, buckets: int, ddl: str, by: list[str]) -> DataFrame:
    """The bucketed table of an earlier run, known to this session's catalog from then on."""
    name = _table(run, kind)
    if not spark.catalog.tableExists(name):
        parts = f"PARTITIONED BY ({', '.join(by)})" if by else ""
        keys = ", ".join(KEYS)
        spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet {parts} CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                  f"INTO {buckets} BUCKETS LOCATION '{root}/{kind}/{run}'")
        if by:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _resolved_pairs(t: LedgerTables, ledger: DataFrame, heavy) -> DataFrame:
    """Every pair of ``ledger`` resolved; heavy ones once a salt."""
    pairs = by_pair(t, ledger.select(*PAIR).distinct())
    salts = F.sequence(F.lit(0), _spread(heavy, 1) - 1)
    return _keyed(pairs).withColumn("salt", F.explode(salts))


def _manifest(spark: SparkSession, root: str) -> dict | None:
    names = sorted(n for n, _ in files.children(spark, f"{root}/manifests") if n.endswith(".json"))
    return json.loads(files.read_text(spark, f"{root}/manifests/{names[-1]}")) if names else None


def _publish(spark: SparkSession, root: str, made: dict) -> None:
    before = _manifest(spark, root)
    made["number"] = 1 if before is None else before["number"] + 1
    if not files.publish_text(spark, f"{root}/manifests/{made['number']:09d}.json", json.dumps(made),
                              f"{root}/aside/{uuid.uuid4().hex}.json"):
        raise RuntimeError(f"{root}: another writer published meanwhile; write again")


def write_store(t: LedgerTables, root: str | None = None, buckets: int = BUCKETS) -> str:
    """Write the ledger and its pairs; returns the root."""
    spark = t.spark
    root = (root or f"{shared_dir(spark)}/ledger_store/{uuid.uuid4().hex}").rstrip("/")
    run = uuid.uuid4().hex
    rows = _keyed(facts(t)).withColumn("pair", F.concat("plan_key", F.lit("/"), "investment_key"))
    heavy = [list(x) for x in heavy_keys(rows, "pair")]
    salt = F.pmod(F.xxhash64("transaction_id"), _spread(heavy, 1)).cast("int")
    rows = rows.drop("pair").withColumn("salt", salt).withColumn("month", F.date_format("transaction_date", "yyyy-MM"))
    _save(rows, root, run, "ledger", buckets, ["month"])
    ledger = spark.table(_table(run, "ledger"))
    pairs = _resolved_pairs(t, ledger, heavy)
    _save(pairs, root, run, "pairs", buckets, [])
    _publish(spark, root, {"ledger": run, "pairs": run, "buckets": buckets, "heavy": heavy,
                           "ledger_ddl": _ddl(ledger), "pairs_ddl": _ddl(pairs)})
    return root


def refresh_pairs(t: LedgerTables, root: str) -> None:
    """Resolve the store's pairs again from ``t``'s plans, users and assets."""
    about = _manifest(t.spark, root)
    if about is None:
        raise ValueError(f"no ledger store in {root}")
    run = uuid.uuid4().hex
    ledger = open_store(t.spark, root).ledger
    _save(_resolved_pairs(t, ledger, about["heavy"]), root, run, "pairs", about["buckets"], [])
    _publish(t.spark, root, {**about, "pairs": run})


def open_store(spark: SparkSession, root: str) -> LedgerStore:
    about = _manifest(spark, root)
    if about is None:
        raise ValueError(f"no ledger store in {root}")
    return LedgerStore(_open(spark, root, about["ledger"], "ledger", about["buckets"], about["ledger_ddl"], ["month"]),
                       _open(spark, root, about["pairs"], "pairs", about["buckets"], about["pairs_ddl"], []))


def ledger_base(store: LedgerStore) -> DataFrame:
    """J17 from the store."""
    return store.rows().filter(eligible()).select(
        "customer_id", "customer_name", "transaction_id", "transaction_type",
        "transaction_date", "ghs_amount", "usd_amount", F.col("provider").alias("pn"))


def transaction_trend(store: LedgerStore, window: Window, granularity: str = "month") -> DataFrame:
    """J2 from the store: the window's months, joined bucket by bucket."""
    period = trend.period_of(F.to_date("transaction_date"), granularity).alias("period")
    return (store.rows(window).filter(eligible() & provider_ok()).groupBy(period, "tx_type")
            .agg(F.sum("ghs_amount").cast("double").alias("total_amount")).orderBy("period", "tx_type"))

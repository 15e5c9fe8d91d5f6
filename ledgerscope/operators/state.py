"""The ledger's mergeable state: metrics over appended batches without reading earlier rows again.

A batch of transactions becomes two tables of partial results per pair of plan ids (nothing is joined, so a
later change of plans, users or assets needs no new state):

* ``cells``: per day, raw and classified type and provider rule, the number of rows, the sums and
  non-null counts of the amounts, and the first and last instant.  Rows at midnight have cells
  of their own: a window ends at a midnight, which belongs to it while the day that it opens does not.
  Every window is a set of whole cells.
* ``instants``: per half hour, the different instants as four-byte offsets into it: a set that merges
  exactly.  The number of different instants of a customer is the sum of its blocks' sizes; blocks of one
  customer lie in many tasks, however many rows the customer has.

Counts and sums add, first and last are min and max, sets unite; so the jobs below give what they give over all
rows at once (J1, J2, J18, J19), whatever the split.

A batch has an id and counts once: its manifest (``batches/<id>.json``) appears by one rename that
fails if it is there, so a repeated or concurrent batch changes nothing, and a run that died has no
manifest.  ``compact`` merges the published batches into a generation that names them; readers
take the newest generation and the batches that it lacks.

Batches hold new rows only: a row that changes after it was appended can't be taken back (min and max can't),
and needs a new state.  Rows count once their status is success.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope import reference_data as rd
from ledgerscope.functions.periods import Window
from ledgerscope.operators import metrics, trend
from ledgerscope.operators.instants import blocks_of, distinct_instants, merged_blocks
from ledgerscope.operators.ledger import PAIR, by_pair, eligible, facts, provider_ok
from ledgerscope.session import shared_dir
from ledgerscope.sources import files
from ledgerscope.sources.tables import LedgerTables

_KINDS = ["tx_type", "transaction_type", "provider_ok"]
CELL_KEYS = [*PAIR, "day", "midnight", *_KINDS]
_SUMS = ["n", "ghs", "ghs_n", "usd", "usd_n"]
BLOCK_KEYS = [*PAIR, "transaction_type", "provider_ok", "block"]


def _classified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("provider_ok", F.coalesce(provider_ok(), F.lit(False)))


def cells_of(rows: DataFrame) -> DataFrame:
    """The cells of ``facts`` rows."""
    day = F.to_date("transaction_date")
    keyed = _classified(rows).withColumns({"day": day, "midnight": F.col("transaction_date") == day.cast("timestamp_ntz")})
    return keyed.groupBy(*CELL_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ghs_amount").alias("ghs"), F.count("ghs_amount").alias("ghs_n"),
        F.sum("usd_amount").alias("usd"), F.count("usd_amount").alias("usd_n"),
        F.min("transaction_date").alias("first_at"), F.max("transaction_date").alias("last_at"))


def merged_cells(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*CELL_KEYS).agg(
        *[F.sum(c).cast(cells.schema[c].dataType).alias(c) for c in _SUMS],
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def instants_of(rows: DataFrame) -> DataFrame:
    return blocks_of(_classified(rows), BLOCK_KEYS[:-1])


class LedgerState:
    """The state under one folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_dir(spark)}/ledger_state").rstrip("/")

    def append(self, batch: str, t: LedgerTables) -> bool:
        """Add the transactions of ``t`` as batch ``batch``; False, and nothing changes, if there is one of that id."""
        if "/" in batch:
            raise ValueError(f"a batch's id is a file's name: {batch!r}")
        if batch in self.batches():
            return False
        run = self._write(cells_of(facts(t)), instants_of(facts(t)))
        manifest = {"batch": batch, "run": run, "added": time.time()}
        if not files.publish_text(self.spark, f"{self.root}/batches/{batch}.json", json.dumps(manifest),
                                  f"{self.root}/data/{run}/_manifest.json"):
            files.delete(self.spark, f"{self.root}/data/{run}")
            return False
        return True

    def _write(self, cells: DataFrame, instants: DataFrame) -> str:
        run = uuid.uuid4().hex
        cells.write.parquet(f"{self.root}/data/{run}/cells")
        instants.write.parquet(f"{self.root}/data/{run}/instants")
        return run

    def _manifests(self, kind: str) -> list[dict]:
        names = sorted(n for n, _ in files.children(self.spark, f"{self.root}/{kind}") if n.endswith(".json"))
        return [json.loads(files.read_text(self.spark, f"{self.root}/{kind}/{n}")) for n in names]

    def batches(self) -> list[str]:
        """Ids of the published batches."""
        return [m["batch"] for m in self._manifests("batches")]

    def _runs(self) -> tuple[list[str], list[str], int]:
        """Runs that together hold every batch once, those batches, and the newest generation's number."""
        generations = self._manifests("generations")
        newest = max(generations, key=lambda m: m["number"], default={"number": 0, "run": None, "batches": []})
        inside = set(newest["batches"])
        rest = [m for m in self._manifests("batches") if m["batch"] not in inside]
        return ([newest["run"]] if newest["run"] else []) + [m["run"] for m in rest], sorted(
            inside | {m["batch"] for m in rest}), newest["number"]

    def _read(self, table: str, runs: list[str]) -> DataFrame:
        if not runs:
            raise ValueError(f"no batch in {self.root}")
        return self.spark.read.parquet(*[f"{self.root}/data/{run}/{table}" for run in runs])

    def cells(self) -> DataFrame:
        return self._read("cells", self._runs()[0])

    def instants(self) -> DataFrame:
        return self._read("instants", self._runs()[0])

    def compact(self) -> bool:
        """Merge all published batches into the next generation; False if another writer was first."""
        runs, inside, number = self._runs()
        run = self._write(merged_cells(self._read("cells", runs)),
                          merged_blocks(self._read("instants", runs), BLOCK_KEYS[:-1]))
        manifest = {"number": number + 1, "run": run, "batches": inside}
        if files.publish_text(self.spark, f"{self.root}/generations/{number + 1:09d}.json", json.dumps(manifest),
                              f"{self.root}/data/{run}/_manifest.json"):
            return True
        files.delete(self.spark, f"{self.root}/data/{run}")
        return False


def _in_window(window: Window):
    """Cells of the window: its days, of the last one midnight alone."""
    return ((F.col("day") >= F.lit(window.start)) & (F.col("day") < F.lit(window.end))
            | (F.col("day") == F.lit(window.end)) & F.col("midnight"))


def general_metrics(state: LedgerState, t: LedgerTables, window: Window,
                    deposit_types=rd.DEPOSIT_TYPES_PLATFORM) -> DataFrame:
    """J1 from the state; ``t`` gives plans and users."""
    dep = F.coalesce(F.col("transaction_type").isin(*deposit_types), F.lit(False))
    wd = F.coalesce((F.col("transaction_type") == rd.WITHDRAWAL_TYPE) & F.col("provider_ok"), F.lit(False))
    rows = state.cells().withColumns({"_dep": dep, "_wd": wd, "_win": _in_window(window)}).filter("_dep OR _win")
    aggs = [F.min(F.when(F.col("_dep"), F.col("first_at"))).alias("first_dep"),
            F.max(F.when(F.col("_dep"), F.col("last_at"))).alias("last_dep"),
            F.coalesce(F.sum(F.when(F.col("_win"), F.col("n"))), F.lit(0)).alias("win_n")]
    for side, flag in (("dep", "_dep"), ("wd", "_wd")):
        held = F.col("_win") & F.col(flag)
        aggs.append(F.coalesce(F.sum(F.when(held, F.col("n"))), F.lit(0)).alias(f"{side}_n"))
        for c in ("ghs", "usd"):
            aggs.append(F.sum(F.when(held, F.col(c))).alias(f"{side}_{c}"))
            aggs.append(F.coalesce(F.sum(F.when(held, F.col(f"{c}_n"))), F.lit(0)).alias(f"{side}_{c}_n"))
    per_pair = rows.groupBy(*PAIR).agg(*aggs)
    names = [c for c in per_pair.columns if c not in PAIR]
    merge = {"first_dep": F.min, "last_dep": F.max}
    level1 = (by_pair(t, per_pair, assets=False).filter(eligible()).groupBy("customer_id")
              .agg(*[merge.get(c, F.sum)(c).alias(c) for c in names]))
    return (level1.filter(F.col("win_n") > 0).agg(*metrics.level2_totals(window)).select(*metrics.GENERAL_COLUMNS))


def transaction_trend(state: LedgerState, t: LedgerTables, window: Window, granularity: str = "month") -> DataFrame:
    """J2 from the state."""
    rows = state.cells().filter(_in_window(window) & F.col("provider_ok"))
    period = trend.period_of(F.col("day"), granularity)
    per_pair = rows.groupBy(*PAIR, period.alias("period"), "tx_type").agg(F.sum("ghs").alias("ghs"))
    return (by_pair(t, per_pair, assets=False).filter(eligible()).groupBy("period", "tx_type")
            .agg(F.sum("ghs").cast("double").alias("total_amount")).orderBy("period", "tx_type"))


def first_transactions(state: LedgerState, t: LedgerTables) -> DataFrame:
    """J19 from the state."""
    per_pair = state.cells().groupBy(*PAIR).agg(F.min("first_at").alias("first_at"))
    return (by_pair(t, per_pair, users=False, assets=False).groupBy(F.col("owner_id").alias("user_id"))
            .agg(F.min("first_at").alias("first_transaction_date")))


def depositors_summary(state: LedgerState, t: LedgerTables, deposit_types=rd.DEPOSIT_TYPES_PLATFORM) -> DataFrame:
    """J18 (platform) from the state."""
    blocks = state.instants().filter(F.col("transaction_type").isin(*deposit_types))
    per_pair = merged_blocks(blocks, PAIR)
    owned = by_pair(t, per_pair, assets=False).filter(eligible())
    return distinct_instants(merged_blocks(owned, ["customer_id"]), ["customer_id"])


def replayed(t: LedgerTables, days: list, root: str | None = None) -> LedgerState:
    """A state of ``t``'s transactions appended in batches cut at the given days, compacted after the first of them."""
    state = LedgerState(t.spark, root or f"{shared_dir(t.spark)}/ledger_state/{uuid.uuid4().hex}")
    at = F.col("updated_at")
    cuts = [None, *[F.lit(d).cast("timestamp_ntz") for d in sorted(days)], None]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        rows = t.transactions
        rows = rows if lo is None else rows.filter(at >= lo)
        rows = rows if hi is None else rows.filter(at < hi)
        if lo is None:  # rows without an instant are in the first batch
            rows = t.transactions.filter((at < hi) | at.isNull()) if hi is not None else t.transactions
        state.append(f"{i:06d}", t.with_transactions(rows))
        if i == 1:
            state.compact()
    return state

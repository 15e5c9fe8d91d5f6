"""Reuse of finished results (J15): a job asked again, over files that have not changed, is looked up.

A result is known by its job, its arguments and the state of the files it was computed from
(``sources.files.files_state``: path, length and time of change of each).  Under the store's root lie

    data/<run>/<table>      what a run wrote (Parquet); a run has a folder of its own
    index/<key>.json        one manifest a finished result: its run, tables, schemas and row counts

A manifest appears by one rename that fails if it is there: of two runs that compute the same result
one is published, and the other drops its own files and reads the published one.  A manifest is
written only if the files' state after the run is what it was before, so a result never stands for
files that it did not read.  A run that dies leaves files without a manifest, which ``sweep`` removes.

Sources that are no files (in-memory frames, JDBC) have no state to compare; their results are
computed every time and not stored.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerscope.session import shared_dir
from ledgerscope.sources import files
from ledgerscope.sources.tables import SOURCE_NAMES, LedgerTables

#: Raised whenever a job's rules change, so that results of the old rules are not found.
RULES = 1

#: ``save(name, frame)`` writes one table of a result and returns it read back.
Save = Callable[[str, DataFrame], DataFrame]


class SourceChanged(RuntimeError):
    """The source's files changed while a result was computed from them."""


def _content(df: DataFrame | None) -> str:
    """State of a frame that is an argument (the fee schedule): a sum over its rows' hashes."""
    if df is None:
        return "none"
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    r = df.agg(F.count("*"), F.sum(mark.cast("decimal(38,0)"))).first()
    return f"{r[0]}-{r[1]}"


class ResultStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_dir(spark)}/results").rstrip("/")

    def key(self, job: str, args: dict, t: LedgerTables, tables=None, fees: DataFrame | None = None) -> str | None:
        """The name of a result; None where the source has no files."""
        if t.paths is None:
            return None
        paths = sorted({p for name in tables or SOURCE_NAMES for p in t.paths[name]})
        known = {"job": job, "args": {k: str(v) for k, v in sorted(args.items())}, "rules": RULES,
                 "source": files.files_state(self.spark, paths), "paths": paths, "fees": _content(fees if fees is not None else t.fees)}
        return hashlib.sha256(json.dumps(known, sort_keys=True).encode()).hexdigest()

    def find(self, key: str) -> dict[str, DataFrame] | None:
        """The tables of a published result; a manifest whose files are gone counts as none and goes too."""
        text = files.read_text(self.spark, f"{self.root}/index/{key}.json")
        if text is None:
            return None
        manifest = json.loads(text)
        folder = f"{self.root}/data/{manifest['run']}"
        if not all(files.exists(self.spark, f"{folder}/{name}/_SUCCESS") for name in manifest["tables"]):
            files.delete(self.spark, f"{self.root}/index/{key}.json")
            return None
        return {name: self.spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{folder}/{name}")
                for name, about in manifest["tables"].items()}

    def reuse(self, job: str, args: dict, t: LedgerTables, build: Callable[[LedgerTables, Save], None],
              tables=None, fees: DataFrame | None = None) -> dict[str, DataFrame]:
        """The tables that ``build`` saves, or those of an earlier run with the same key.

        ``build`` gets the tables as they are now (``LedgerTables.reopen``).  ``tables``: the logical tables
        that the job reads; a change of others leaves its result valid.
        """
        key = self.key(job, args, t, tables, fees)
        if key is not None and (found := self.find(key)) is not None:
            return found
        run, made = uuid.uuid4().hex, {}
        folder = f"{self.root}/data/{run}"

        def save(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            made[name] = self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")
            return made[name]

        build(t if t.reopen is None else t.reopen(), save)
        if key is None:
            return made
        if self.key(job, args, t, tables, fees) != key:
            files.delete(self.spark, folder)
            raise SourceChanged(f"{job}: the source's files changed during the run; run it again")
        manifest = {"job": job, "args": {k: str(v) for k, v in args.items()}, "run": run, "finished": time.time(),
                    "tables": {n: {"rows": df.count(), "schema": df.schema.jsonValue()} for n, df in made.items()}}
        if not files.publish_text(self.spark, f"{self.root}/index/{key}.json", json.dumps(manifest), f"{folder}/_manifest.json"):
            found = self.find(key)
            if found is not None:  # another run was first
                files.delete(self.spark, folder)
                return found
        return made

    def entries(self) -> dict[str, dict]:
        """Key -> manifest of every published result."""
        names = [n for n, _ in files.children(self.spark, f"{self.root}/index") if n.endswith(".json")]
        found = {n[:-5]: files.read_text(self.spark, f"{self.root}/index/{n}") for n in names}
        return {k: json.loads(v) for k, v in found.items() if v is not None}

    def sweep(self, older_than: float = 86_400.0) -> list[str]:
        """Delete runs that no manifest names and that began more than ``older_than`` seconds ago; their names."""
        named = {m["run"] for m in self.entries().values()}
        limit = (time.time() - older_than) * 1000
        gone = [n for n, changed in files.children(self.spark, f"{self.root}/data") if n not in named and changed < limit]
        for name in gone:
            files.delete(self.spark, f"{self.root}/data/{name}")
        return gone

    def forget(self, older_than: float) -> int:
        """Withdraw results finished more than ``older_than`` seconds ago, manifests first; how many."""
        old = {k: m for k, m in self.entries().items() if m["finished"] < time.time() - older_than}
        for key in old:
            files.delete(self.spark, f"{self.root}/index/{key}.json")
        for manifest in old.values():
            files.delete(self.spark, f"{self.root}/data/{manifest['run']}")
        return len(old)

"""Session construction and the shared folder for durable intermediate data."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  Timestamps are kept as
# TIMESTAMP_NTZ end to end; the session zone only matters where Spark turns an
# NTZ value into a zoned one (``date_trunc``), and UTC makes that lossless.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
}


# Starting point for a large cluster reading the full ledger (~100 TB of
# transactions).  Scans split into 512 MB partitions (about 200k map tasks
# for 100 TB); every money job aggregates map-side before its one shuffle,
# so the shuffle carries per-customer partials, not transactions.  The
# initial shuffle width is high and AQE coalesces it to ~256 MB partitions;
# skewed join partitions (a hot plan or customer) are split by AQE.
# Dimensions (plans, users) are broadcast while one job's broadcasts stay
# within maxBytes (and each within maxRows); the others are sort-merge
# joined with NULL-key spreading (operators.joins).
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "256m",
    "spark.sql.broadcastTimeout": "900",
    "ledgerscope.broadcast.maxRows": "2000000",
    "ledgerscope.broadcast.maxBytes": "268435456",
}


def build_session(master: str | None = "local[*]", app: str = "ledgerscope",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None,
                  cluster: bool = False) -> SparkSession:
    """Create (or reuse) a session with ``CORE_CONF`` applied.

    On a cluster, leave ``master`` to spark-submit (pass ``None``) and size
    ``shuffle_partitions`` so that one post-shuffle partition is a few hundred
    MB; AQE coalesces small ones at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(CORE_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(key, conf[key])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables, visible to every executor.

    The cluster names it in ``spark.checkpoint.dir``; that setting is read from
    the session.  Only when it is unset (local tests) is a fresh temporary
    folder created and registered; on a cluster that folder would be one
    machine's own, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir().rstrip("/")

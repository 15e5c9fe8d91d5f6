"""Helpers shared by the operators: tables, durable intermediates, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ledgerscope.session import shared_dir

# Text bytes that one vectorised step looks at; bounds numpy's temporaries.
STEP_BYTES = 1 << 19
#: Narrow rows a file.
ROWS_A_FILE = 250_000
#: Bytes of a table's files that a task of a map job reads, where the session cuts files smaller.
TASK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(size: str) -> int:
    """Bytes of a setting such as ``16m``, ``1MB`` or ``134217728b``; a bare number counts bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def joined(df: DataFrame) -> DataFrame:
    """``df``, a table read from files, in tasks of about ``TASK_BYTES``, whole rounds of the cluster's cores.

    For map jobs, which write a file a task: where the session cuts files smaller, neighbouring cuts are read by one
    task.  No row is moved, and tasks never become fewer than the cores.
    """
    spark = df.sparkSession
    cut = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if cut >= TASK_BYTES:
        return df
    cuts, cores = df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    tasks = -(-max(1, -(-cuts * cut // TASK_BYTES)) // cores) * cores
    return df.coalesce(tasks) if tasks < cuts else df


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder (``spark.checkpoint.dir``)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_written: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """The folders that ``durable`` writes meanwhile; those still in the list are deleted at the end."""
    _written.append(folders := [])
    try:
        yield folders
    finally:
        _written.pop()
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings_kept(spark: SparkSession) -> Iterator[None]:
    """Puts back what ``text_batches`` sets."""
    before = {key: spark.conf.get(key, None) for key, _, _ in _BATCHES}
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _joins(spark: SparkSession) -> bool:
    """Whether Spark joins small partitions itself."""
    return all(spark.conf.get(key, "true") == "true" for key in (
        "spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"))


def _files(spark: SparkSession, rows: int) -> int | None:
    """Files for about ``rows`` narrow rows; None where Spark joins small partitions itself or has no more than that."""
    files = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE))
    return None if _joins(spark) or files >= int(spark.conf.get("spark.sql.shuffle.partitions")) else files


def durable(df: DataFrame, name: str, rows: int | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, not the work
    above, and the rows are the same for every later reader.

    ``rows``: about how many narrow ones, if known.  They are then dealt into as many files as they warrant, one per
    ``ROWS_A_FILE``, not one a partition of the step that makes them; larger partitions than that are split by size
    where the session joins small ones.
    ``wide``: rows too large to be dealt again just for that, given as so many narrow ones.  A local file system changes each file's mode by a process of its own, and while that starts it counts the
    whole memory of the executor again, or the driver's for the marker of success, which is left out.
    """
    spark = df.sparkSession
    if rows is not None:
        few = max(1, -(-rows // ROWS_A_FILE))
        df = df.repartition(few) if _files(spark, rows) else df.hint("rebalance", few) if _joins(spark) and not wide else df
    path = run_folder(spark, name)
    if _written:
        _written[-1].append(path)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def holding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that computes a frame and keeps its rows on the executors' disks until the end.

    For small steps that only the work meanwhile reads: no files in the shared folder (``durable``).  Partitions of a
    lost executor are computed again, so the shuffles below a frame stay as long as it does.
    """
    frames: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        frames.append(df.persist(StorageLevel.DISK_ONLY))
        df.count()
        return df

    try:
        yield hold
    finally:
        for df in frames:
            df.unpersist()


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1, from 0) of an Arrow string column.

    Null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, width)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def row_runs(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``step`` bytes, one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + step, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
            ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"))


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for rows that carry whole texts, unless the session has set its own.

    The defaults (10,000 rows, 64 MB) suit narrow rows; a task's JVM and Python each hold a few
    batches at a time.
    """
    for key, usual, mine in _BATCHES:
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, mine)


_tools: dict = {}


def tool(key: tuple, make: Callable):
    """What a Python worker keeps between tasks: one operator's tool at a time, made by ``make``."""
    if key not in _tools:
        put_away()
        _tools[key] = make()
    return _tools[key]


def put_away() -> None:
    """Drop another operator's tool, tens of MB a worker, before this one's work begins."""
    if _tools:
        _tools.clear()
        give_back()


def give_back() -> None:
    """Return what a finished task has freed to the system; a Python worker lives on for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme, as tasks outside the JVM open it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def file_system(uri: str):
    """``(file system, path in it)`` of a qualified path, for tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)

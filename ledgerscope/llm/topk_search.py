"""Exact top-k inner-product search with block-at-a-time pruning.

A component's quantised value, ``floor(SCALE * x)``, is a term with a weight;
a block is a range of ``BLOCK`` vectors in id order with its forward index (the
weights of its vectors) and, for every term, the largest and smallest weight in
it.  For a query the sum over its terms of weight times the block's maximum
(minimum for negative weights) bounds every score in the block.  Blocks are
scored in descending order of that bound until it falls below the query's k-th
best score so far; an equal bound is scored, as a smaller id may win the tie.

Vectors are dealt by id ranges to shards of about ``SHARD`` vectors and written
as block rows to the shared folder.  Work is a list of (shard, query group)
rows: a task reads one group of ``GROUP`` queries and one block at a time, so
memory is bounded, nothing is joined and a lost task is read again.  Each query's
best of every shard meet in one window by query.

Defined results: vectors that are null, or hold null or non-finite components,
take no part, as queries or candidates; a shorter vector counts as ending in
zeros; an empty vector scores 0; null ids take no part; of rows of equal
id each asks and is a candidate by itself, but no row is a candidate of a query
with its id; fewer than ``k`` candidates give all; an empty table gives an empty result;
other columns are ignored.  Scores are exact integers below 2 ** 63.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable, file_system, qualified, run_folder

SCALE = 64
TOP = 20
BLOCK = 256
SHARD = 16_384
GROUP = 512

_LEAST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_FILES = "path string, kind string, number long, blocks long, rows long"


def _exact_type(a: np.ndarray, b: np.ndarray):
    """A type in which all inner products of the two sets of rows are exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def _widened(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] == width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


#: Most shards that a task opens one after the other, and how many tasks a shuffle partition should still leave.
MOST_SHARDS, TASKS_A_PART = 16, 4


class Queries:
    """A group of queries and the best that each has met so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows = ids, rows
        # Places not taken hold the least score and the largest id.
        self.best_score = np.full((len(ids), k), _LEAST, np.int64)
        self.best_id = np.full((len(ids), k), _LAST, np.int64)

    def _take(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge the scores of queries ``of`` with rows ``ids``."""
        scores = np.where(ids[None, :] != self.ids[of, None], scores, _LEAST)
        near = (scores >= self.best_score[of, -1:]).any(axis=1)
        of, scores = of[near], scores[near]
        k = self.best_score.shape[1]
        every = np.broadcast_to(ids, scores.shape)
        scores = np.concatenate([self.best_score[of], scores], axis=1)
        every = np.concatenate([self.best_id[of], np.where(scores[:, k:] > _LEAST, every, _LAST)], axis=1)
        order = np.lexsort((every, ~scores))[:, :k]  # ~ reverses the order of integers
        self.best_score[of] = np.take_along_axis(scores, order, axis=1)
        self.best_id[of] = np.take_along_axis(every, order, axis=1)

    def search(self, maxima: np.ndarray, minima: np.ndarray, block) -> int:
        """Score blocks (``block(i)`` gives ids and rows) while they can matter; how many pairs of
        query and block were scored."""
        width = max(self.rows.shape[1], maxima.shape[1])
        q, high, low = (_widened(x, width) for x in (self.rows, maxima, minima))
        kind = _exact_type(q, np.concatenate([high, low]))
        up, down = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
        bounds = (up @ high.T.astype(kind) + down @ low.T.astype(kind)).astype(np.int64)
        # All queries of the group pass the blocks in the order of each one's own bounds:
        # round r scores every query's r-th best block, queries of one block together.
        order = np.argsort(~bounds, axis=1, kind="stable")
        alive, scored = np.arange(len(q)), 0
        q = q.astype(kind)
        for r in range(len(maxima)):
            alive = alive[bounds[alive, order[alive, r]] >= self.best_score[alive, -1]]
            if not len(alive):
                break
            now = order[alive, r]
            for b in np.unique(now).tolist():
                of = alive[now == b]
                ids, rows = block(b)
                scores = (q[of] @ _widened(rows, width).T.astype(kind)).astype(np.int64)
                self._take(of, ids, scores)
                scored += len(of)
        return scored

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, id and score of what each query kept."""
        row, place = np.nonzero(self.best_score > _LEAST)
        return row, self.best_id[row, place], self.best_score[row, place]


def quantised(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, and their floor(SCALE * x), zero-padded."""
    flat = lists.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64) if len(flat) else np.zeros(0)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
    ends = np.cumsum(sizes)
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    whole = (bad[ends] == bad[ends - sizes]) & np.asarray(lists.is_valid())
    numbers = np.flatnonzero(whole)
    out = np.zeros((len(numbers), int(sizes.max(initial=0))), np.int64)
    held = sizes[numbers]
    row = np.repeat(np.arange(len(numbers)), held)
    place = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    out[row, place] = np.floor(SCALE * values[np.repeat(ends[numbers] - held, held) + place])
    return numbers, out


def _write_blocks(vectors: DataFrame, folder: str, kind: str, rows_a_file: int, rows_a_block: int) -> DataFrame:
    """Write ``id, vector`` in id order as files of block rows; a manifest row a file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held_ids, held, state = [], [], {"file": None, "blocks": 0, "rows": 0}
        done = []

        def put(n: int) -> None:
            ids, rows = np.concatenate(held_ids), held
            width = max(x.shape[1] for x in rows)
            rows = np.concatenate([_widened(x, width) for x in rows])
            now_ids, now = ids[:n], rows[:n]
            held_ids[:], held[:] = ([ids[n:]], [rows[n:]]) if len(ids) > n else ([], [])
            if state["file"] is None:
                files, top = file_system(folder)
                files.create_dir(top, recursive=True)
                name = f"{kind}-{number:06d}-{uuid.uuid4().hex[:12]}.parquet"
                state["path"] = f"{folder}/{name}"
                state["file"] = pq.ParquetWriter(f"{top}/{name}", _BLOCK_SCHEMA, filesystem=files)
            state["file"].write_table(pa.table({
                "width": [width], "ids": [now_ids.astype("<i8").tobytes()], "rows": [now.astype("<i8").tobytes()],
                "high": [now.max(axis=0, initial=np.iinfo(np.int64).min).astype("<i8").tobytes()],
                "low": [now.min(axis=0, initial=np.iinfo(np.int64).max).astype("<i8").tobytes()]}, _BLOCK_SCHEMA))
            state["blocks"] += 1
            state["rows"] += len(now_ids)
            if state["rows"] >= rows_a_file:
                close()

        def close() -> None:
            state["file"].close()
            done.append((state["path"], kind, number, state["blocks"], state["rows"]))
            state.update(file=None, blocks=0, rows=0)

        for batch in batches:
            numbers, rows = quantised(batch.column("vector"))
            if len(numbers):
                held_ids.append(np.asarray(batch.column("id"))[numbers])
                held.append(rows)
                while sum(map(len, held_ids)) >= rows_a_block:
                    put(rows_a_block)
        if held_ids:
            put(rows_a_block)
        if state["file"] is not None:
            close()
        path, kinds, num, blocks, rows = zip(*done) if done else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(path, pa.string()), pa.array(kinds, pa.string()), pa.array(num, pa.int64()),
             pa.array(blocks, pa.int64()), pa.array(rows, pa.int64())],
            names=["path", "kind", "number", "blocks", "rows"])

    return vectors.mapInArrow(write, _FILES)


_BLOCK_SCHEMA = pa.schema([("width", pa.int64()), ("ids", pa.binary()), ("rows", pa.binary()),
                           ("high", pa.binary()), ("low", pa.binary())])


class Shard:
    """Block rows of one file: maxima and minima at hand, forward indexes read block by block."""

    def __init__(self, uri: str, kept: int = 64):
        files, path = file_system(uri)
        self.file = pq.ParquetFile(files.open_input_file(path))
        ends = self.file.read(columns=["width", "high", "low"])
        widths = ends["width"].to_pylist()
        self.width = max(widths, default=0)
        cut = lambda name: np.concatenate([
            _widened(np.frombuffer(x, "<i8").reshape(1, -1), self.width) for x in ends[name].to_pylist()])
        self.maxima, self.minima = cut("high"), cut("low")
        self.kept, self.blocks = kept, {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.blocks:
            if len(self.blocks) >= self.kept:
                self.blocks.pop(next(iter(self.blocks)))
            t = self.file.read_row_group(i, columns=["width", "ids", "rows"])
            width = t["width"][0].as_py()
            ids = np.frombuffer(t["ids"][0].as_buffer(), "<i8")
            self.blocks[i] = ids, np.frombuffer(t["rows"][0].as_buffer(), "<i8").reshape(len(ids), width)
        return self.blocks[i]


def search(queries: DataFrame, vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
           k: int = TOP, block: int = BLOCK, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vectors`` for each query row."""
    spark = vectors.sparkSession
    folder = qualified(spark, run_folder(spark, "topk"))

    def ordered(df: DataFrame, rows_a_file: int) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where(
            F.col("id").isNotNull() & F.col("vector").isNotNull())
        files = max(1, -(-rows.count() // rows_a_file))
        # Coalescing joins neighbours where the session deals out to more partitions than asked for.
        return rows.repartitionByRange(files, "id").sortWithinPartitions("id").coalesce(files)

    files = durable(_write_blocks(ordered(vectors, shard), folder, "shard", shard, block).unionByName(
        _write_blocks(ordered(queries, group), folder, "query", group, group)), "topk-files")
    groups = files.where("kind = 'query'").select(
        F.col("path").alias("group"), F.row_number().over(Window.orderBy("path")).alias("at"))
    # Each query file meets each shard file, in runs of shards: lists of file names, not of rows.  A run keeps what its
    # queries have found, so the k-th score of one shard prunes the next, and a query's rows leave once a run.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards, n_groups = (files.where(f"kind = '{kind}'").count() for kind in ("shard", "query"))
    run_length = max(1, min(MOST_SHARDS, n_shards * n_groups // (TASKS_A_PART * parts)))
    runs = (files.where("kind = 'shard'").withColumn("at_shard", F.row_number().over(Window.orderBy("path")))
            .groupBy(F.floor(F.col("at_shard") / run_length).alias("run"))
            .agg(F.sort_array(F.collect_list("path")).alias("shards")))
    meetings = runs.select("run", "shards", F.explode(F.sequence(F.lit(1), F.lit(n_groups))).alias("at"))
    work = meetings.join(groups, "at").select("run", "shards", "group").repartition(parts, "run", "group").sortWithinPartitions(
        "run", "group").drop("run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Shard] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if not opened.keys() >= set(row["shards"]):
                    opened = {}  # the next run's shards
                asked = Shard(row["group"])
                met = [Queries(*asked.block(i), k) for i in range(len(asked.maxima))]
                for path in row["shards"]:
                    shard_ = opened.setdefault(path, Shard(path)) if path not in opened else opened[path]
                    for q in met:
                        q.search(shard_.maxima, shard_.minima, shard_.block)
                for i, q in enumerate(met):
                    at, found, score = q.results()
                    asker = (zlib.crc32(row["group"].encode()) << 31) + i * group + at
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q.ids[at]), pa.array(asker), pa.array(found), pa.array(score)],
                        names=["query_id", "asker", "vec_id", "score"])

    # Rows of equal id that ask each have a list of their own.
    best = Window.partitionBy("query_id", "asker").orderBy(F.desc("score"), "vec_id")
    return (work.mapInArrow(run, "query_id long, asker long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors.where(F.col("vec_id") % 20 == 0), vectors)

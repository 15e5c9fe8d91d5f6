"""Importance resampling of documents towards a target distribution of hashed n-grams.

Documents and target texts are bags of hashed features: runs of consecutive words, each in bucket
crc32 mod ``buckets``.  A bucket's gain is the scaled log ratio of its smoothed shares in target and documents;
a document's weight is the sum of its features' gains.  Gumbel noise from a hash of the key
makes the highest scores a sample without replacement, in proportion to the weights' exponentials.

Features are made by Arrow kernels, a batch of texts at a time: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode``.  Dictionary indices shifted against
themselves are the runs; each different run is hashed once; ``take`` spreads its bucket or gain over
its occurrences, and differences of a running sum reduce them to documents.

Counts leave a task as one row a bucket.  The only data that reaches the driver are ``buckets`` counts
and one row a partition of the ordering.  Ranks come from a range partitioning by score: a row's place
is its place within its partition plus the rows of those before.

Defined results: null and empty texts, and texts without words, have no features and weight 0; a null
key draws as an empty one and comes after others on a tie; equal rows get ranks of their own;
without target features the gains level the documents' own distribution out; empty
tables give empty results; ``importance_scores`` passes other columns through, except
ones named like a result column, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable, give_back, row_runs, table, text_batches, text_buffer

BUCKETS = 10_000
LENGTHS = (1, 1)
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
SCALE = 1000
#: What separates words, after lower-casing A-Z.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ``monotonically_increasing_id``: the partition above this many bits, the row's place in it below.
_PLACE_BITS = 33


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, dictionary-encoded, and the number of the text that each is from."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_BETWEEN)
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    given = pc.not_equal(pc.binary_length(words), 0)  # a text that begins or ends with no word
    words, parents = words.filter(given), parents.filter(given)
    return words.dictionary_encode(), parents.to_numpy(zero_copy_only=False).astype(np.int64)


def _crcs(words: pa.Array) -> list[int]:
    raw, at = text_buffer(words)
    data, at = raw.tobytes(), at.tolist()
    return [crc32(data[a:b]) for a, b in zip(at, at[1:])]


def features(texts: pa.Array, buckets: int = BUCKETS, lengths: tuple[int, int] = LENGTHS
             ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bucket, text number)`` of every feature in order of place, one pair of arrays for each run length."""
    encoded, parent = words_of(texts)
    index = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    crcs = np.array(_crcs(encoded.dictionary), np.int64)
    tails = None
    run, run_crc = index, crcs
    for k in range(1, lengths[1] + 1):
        if k > 1:
            # Runs one word longer: shifted indices side by side, different pairs hashed once.
            if tails is None:
                raw, at = text_buffer(encoded.dictionary)
                data, at = raw.tobytes(), at.tolist()
                tails = [b" " + data[a:b] for a, b in zip(at, at[1:])]
            pairs = run[:-1] * max(1, len(crcs)) + index[k - 1:]
            pairs, run = np.unique(pairs, return_inverse=True)
            head, tail = np.divmod(pairs, max(1, len(crcs)))
            run_crc = np.array([crc32(tails[t], h) for h, t in zip(run_crc[head].tolist(), tail.tolist())], np.int64)
        if len(index) < k:
            return
        if k >= lengths[0]:
            inside = parent[:len(run)] == parent[k - 1:]
            yield np.take(run_crc % buckets, run[inside]), parent[:len(run)][inside]


def _steps(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in steps of bounded bytes (a longer text by itself)."""
    for lo, hi in row_runs(text_buffer(texts)[1]):
        yield texts.slice(lo, hi - lo)


def feature_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS,
                   lengths: tuple[int, int] = LENGTHS) -> DataFrame:
    """``bucket, count`` over all texts; each task sends at most one row a bucket."""
    text_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _steps(batch.column(0)):
                for bucket, _ in features(texts, buckets, lengths):
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "count"])
        give_back()

    each = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, count long")
    return each.groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
                 buckets: int = BUCKETS, lengths: tuple[int, int] = LENGTHS) -> DataFrame:
    """``bucket, gain`` of every bucket: ``floor(1000 ln(share in target / share in docs))``, each share
    smoothed by one feature a bucket."""
    kinds = (feature_counts(docs, text, buckets, lengths).select("bucket", F.col("count").alias("s"), F.lit(0).cast("long").alias("t"))
             .union(feature_counts(target, target_text, buckets, lengths).select(
                 "bucket", F.lit(0).cast("long"), "count"))
             .union(docs.sparkSession.range(buckets).select(F.col("id").cast("int"), F.lit(0).cast("long"), F.lit(0).cast("long"))))
    # A row a bucket, so the totals are joined on from one row.
    counts = durable(kinds.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "feature-counts")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return counts.select("bucket", F.floor(F.lit(float(SCALE)) * F.log(up / down)).cast("long").alias("gain"))


def noise(key: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise of a key, from the first 32 bits of its hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(float(-SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def importance_scores(docs: DataFrame, gains: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED,
                      lengths: tuple[int, int] = LENGTHS) -> DataFrame:
    """``docs`` with ``n_words, n_features, weight, score``; a map job.  ``gains`` has a row a bucket."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = gains.collect()  # as many as there are buckets
    values = np.zeros(len(rows), np.int64)
    values[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    shared = spark.sparkContext.broadcast(values)

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def measure(column: pa.Array) -> pa.Array:
        gain, parts = shared.value, []
        for texts in _steps(column):
            n = len(texts)
            n_words = np.bincount(words_of(texts)[1], minlength=n) if lengths[0] > 1 else None
            n_features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, (bucket, parent) in enumerate(features(texts, len(gain), lengths)):
                ends = np.searchsorted(parent, np.arange(n + 1))
                running = np.concatenate([[0], np.cumsum(np.take(gain, bucket))])
                n_features += np.diff(ends)
                weight += running[ends[1:]] - running[ends[:-1]]
                if i == 0 and n_words is None:
                    n_words = np.diff(ends)
            parts.append(np.stack([n_features if n_words is None else n_words, n_features, weight]))
        made = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
        give_back()
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in made], names=["n_words", "n_features", "weight"])

    kept = docs.drop(*[c for c in ("n_words", "n_features", "weight", "score") if c not in (key, text)])
    return (kept.withColumn("_m", measure(F.col(text)))
            .withColumns({c: F.col(f"_m.{c}") for c in ("n_words", "n_features", "weight")})
            .withColumn("score", F.col("weight") + noise(F.col(key), seed)).drop("_m"))


def draw(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... by score for the ``percent`` highest of the rows with ``least_words``
    words at least, null for the others.  Ties go to the smaller key.

    ``scored`` should carry what the sample needs of a document (its key), not its text: its rows are
    written and shuffled.
    """
    spark = scored.sparkSession
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    # Written first: a range partitioning samples its input, and would measure the texts twice.
    stored = durable(scored.withColumn("_able", able), "scores")
    order = [F.desc("_able"), F.desc("score"), F.asc_nulls_last(key), F.desc("n_features")]
    placed = durable(stored.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
                     .sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", _PLACE_BITS)
    held = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.count_if("_able").alias("able")).collect()
    before, total = [], 0
    for r in sorted(held, key=lambda r: r["part"]):  # a row a partition
        before.append((r["part"], total))
        total += r["rows"]
    drawn = sum(r["able"] for r in held) * percent // 100
    offsets = spark.createDataFrame(before, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1) + 1
    return (placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn("rank", F.when(rank <= drawn, rank)).select(*[c for c in scored.columns if c != "rank"], "rank"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gains = bucket_gains(docs, table(spark, sf_dir, "benchmark"))
    scored = importance_scores(docs, gains).select("doc_id", "n_words", "n_features", "weight", "score")
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")

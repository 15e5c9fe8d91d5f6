"""Membership filters: which rows of a large relation can't meet a set of keys, told before any shuffle.

A Bloom filter as an array of 64-bit words, made by aggregates and read by column functions.  It is a scalar
subquery of the job that uses it, computed when that runs; its size is fixed beforehand from a count that bounds the
keys and is at most ``MOST_BITS``.  With more keys than that serves, it only passes more rows: it drops no
row that has a key in the set, and the join that follows is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest filter: 4 MB.
MOST_BITS = 1 << 25
BITS_A_KEY = 12
HASHES = 3


def bits_for(keys: int) -> int:
    """A power of two: ``BITS_A_KEY`` bits a key, within 2^13 and ``MOST_BITS``."""
    return min(MOST_BITS, max(1 << 13, 1 << (BITS_A_KEY * max(1, keys) - 1).bit_length()))


def _places(value: Column, bits: int) -> list[Column]:
    mask = F.lit(bits - 1).cast("long")
    first = F.xxhash64(value).bitwiseAND(mask)
    step = F.xxhash64(value, F.lit(1)).bitwiseAND(mask)
    return [(first + step * i).bitwiseAND(mask) for i in range(HASHES)]


def bloom(keys: DataFrame, column: str, bits: int) -> Column:
    """The filter over ``column`` of ``keys``, as a scalar subquery: ``array<bigint>``."""
    spark = keys.sparkSession
    at = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*_places(F.col(column), bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
    dense = spark.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    listed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return dense.agg(F.transform(listed, lambda x: x["bits"]).alias("words")).scalar()


def may_hold(words: Column, value: Column, bits: int) -> Column:
    """False where ``value`` is not among the filter's keys for certain, or null."""
    test = value.isNotNull()
    for at in _places(value, bits):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        test = test & (F.call_function("shiftrightunsigned", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    return test


def kept(rows: DataFrame, words: Column, value: Column, bits: int) -> DataFrame:
    """The rows whose ``value`` the filter may hold; the filter is computed once for them."""
    return rows.withColumn("_members", words).where(may_hold(F.col("_members"), value, bits)).drop("_members")


def read_once(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``_tested``, a struct of ``columns``, for tests that use a computed column often.

    A test is moved below the column that it uses and has that column's whole expression in each of its uses:
    at three places a key the filter becomes a method too long for the JVM to compile.  A generator's output stays.
    """
    return rows.withColumn("_tested", F.explode(F.array(F.struct(*columns))))

"""Different instants per key, as sets that merge exactly.

Time is cut into blocks of half an hour.  Within a block an instant is a four-byte offset, and a block's different
instants are a sorted array of them.  Sets of one block unite; the number of different instants of a key
is the sum of its blocks' sizes.  A group is one key's half hour, so a key with a large part of
all rows is spread over tasks; sets are collected in each task before the shuffle.

Rows without an instant are counted, in a block of their own that holds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a block; its microseconds fit four bytes.
BLOCK_SECONDS = 1800


def _micros() -> Column:
    """Microseconds of a zone-free instant, in any session zone."""
    since = F.lit("1970-01-01").cast("date").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", since, F.col("transaction_date"))


def blocks_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block, n, offsets``: the rows and the different instants of each half hour."""
    at = _micros()
    width = F.lit(BLOCK_SECONDS * 1_000_000)
    timed = rows.withColumns(
        {"block": F.floor(at / width).cast("long"), "_offset": F.pmod(at, width).cast("int")})
    return timed.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("_offset")).alias("offsets"))


def merged_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of ``keys`` united.  A group holds the instants of one half hour."""
    return blocks.groupBy(*keys, "block").agg(
        F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("offsets"))).alias("offsets"))


def distinct_instants(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, deposit_count, first_deposit_date, tx_days`` from united blocks: rows, first and number of instants."""
    first = F.col("block") * (BLOCK_SECONDS * 1_000_000) + F.array_min("offsets")
    since = F.lit("1970-01-01").cast("date").cast("timestamp_ntz")
    return (blocks.groupBy(*keys).agg(F.sum("n").alias("deposit_count"), F.min(first).alias("_first"),
                                      F.sum(F.size("offsets")).alias("tx_days"))
            .select(*keys, "deposit_count",
                    F.timestamp_add("MICROSECOND", F.col("_first"), since).alias("first_deposit_date"), "tx_days"))

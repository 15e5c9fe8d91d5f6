"""Join helpers that keep the fact table's shuffles few and balanced.

``dimension_join`` is how the ledger meets a dimension (plans, investment
plans, users, assets): a left equi-join on a nullable foreign key against a
unique dimension key.

* If the dimension is within the broadcast bounds (rows of the table, and
  bytes over all that one job broadcasts; each table is counted once, on
  Parquet from file footers), it is broadcast and the fact table is not
  shuffled at all.
* Otherwise the planner's sort-merge join is used, and fact rows whose key
  is NULL - in this ledger a large share of transactions carry no savings
  plan or no investment plan - are scattered over ``NULL_KEY_SPREAD`` salt
  values instead of all hashing to one reducer.  Matched keys have salt 0 on
  both sides, so the result is the plain left join.  (The dimension's salt is
  written as ``key - key`` so the optimizer keeps it as a join key instead of
  folding a literal 0 into a post-join filter.)  Where raw rows are joined (J17, J20), keys that
  hold a large part of them are found beforehand (``heavy_keys``), salted, and their dimension rows
  repeated; elsewhere partial aggregates a plan are joined, which no plan can make hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL_KEY_SPREAD = 1024
BROADCAST_ROWS_CONF = "ledgerscope.broadcast.maxRows"
DEFAULT_BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES_CONF = "ledgerscope.broadcast.maxBytes"
DEFAULT_BROADCAST_BYTES = 256 << 20


def broadcast_row_limit(spark) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))


def broadcast_byte_limit(spark) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_CONF, str(DEFAULT_BROADCAST_BYTES)))


def row_bytes(df: DataFrame) -> int:
    """Bytes that a row of ``df`` takes by its types (Spark's own default widths)."""
    return int(df._jdf.schema().defaultSize())


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows: texts as long as they are, other columns by their type's width.

    One aggregate over the text columns; every task sends one row.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    fixed = max(8, row_bytes(df.drop(*texts))) if len(texts) < len(df.columns) else 8
    each = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") + 8 for c in texts), F.lit(0).cast("long"))
    return int(df.agg(F.sum(each + fixed)).first()[0] or 0)


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows.

    A plain count: every task sends one number.  (A limit in front of it would
    send up to the limit's rows of every task to one.)
    """
    return df.count() <= max_rows


#: Counters of the heavy-hitter summary, and the share of all rows from which a key is heavy.
HEAVY_COUNTERS = 1024
HEAVY_SHARE = 0.005
#: Tasks that the rows of a heavy key are dealt to, at most; replicas of its dimension row.
HEAVY_SPREAD = 256


def heavy_keys(fact: DataFrame, key: str, share: float = HEAVY_SHARE, counters: int = HEAVY_COUNTERS) -> tuple:
    """``(value, spread)`` of the keys that hold more than ``share`` of the rows with a key.

    One pass, by Spark's ``approx_top_k``: a frequent-items summary of at most ``counters`` counters a task, merged
    over tasks.  It overlooks no key with more than 1 / (0.75 * ``counters``) of the rows and may name a lesser
    one, which costs some replicas and nothing else.  ``spread`` is in proportion to the key's rows.
    """
    top = int(1 / share)
    r = fact.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k({key}, {top}, {counters})").alias("top"), F.count(F.lit(1)).alias("rows")).first()
    found = [(x["item"], x["count"]) for x in r["top"] or () if x["count"] > share * r["rows"]]
    return tuple((value, max(2, min(HEAVY_SPREAD, round(HEAVY_SPREAD * 4 * count / r["rows"])))) for value, count in found)


def dimension_join(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str, small: bool, spread_by: str,
                   spread: int = NULL_KEY_SPREAD, heavy: tuple = ()) -> DataFrame:
    """``fact LEFT JOIN dim ON fact.fact_key = dim.dim_key`` (``dim_key`` unique).

    ``small`` says the dimension passed the row-bound check; ``spread_by`` is
    a fact column (the row id) used to scatter NULL-key rows otherwise.  ``heavy``: keys of
    ``heavy_keys``; their rows are dealt over salts 0 to spread - 1 and their dimension row is repeated
    for each.
    """
    if small:
        return fact.join(F.broadcast(dim), F.col(fact_key) == F.col(dim_key), "left")
    scattered = F.pmod(F.xxhash64(F.col(spread_by)), F.lit(spread)) + 1
    salt = F.when(F.col(fact_key).isNull(), scattered)
    replicas = F.lit(1)
    for value, parts in heavy:
        salt = salt.when(F.col(fact_key) == F.lit(value), F.pmod(F.xxhash64(F.col(spread_by)), F.lit(parts)))
        replicas = F.when(F.col(dim_key) == F.lit(value), F.lit(parts)).otherwise(replicas)
    f = fact.withColumn("_nk", salt.otherwise(0).cast("bigint"))
    if heavy:
        d = dim.withColumn("_nk_d", F.explode(F.sequence(F.lit(0).cast("bigint"), (replicas - 1).cast("bigint"))))
    else:
        d = dim.withColumn("_nk_d", (F.col(dim_key) - F.col(dim_key)).cast("bigint"))
    cond = (f[fact_key] == d[dim_key]) & (f["_nk"] == d["_nk_d"])
    return f.join(d, cond, "left").drop("_nk", "_nk_d")

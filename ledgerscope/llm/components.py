"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many different edges ``a > b`` there are, and whether each component is a star around its smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    count, other = nodes.agg(F.sum("up"), F.max(F.expr("up > 1 OR up = 1 AND down > 0"))).first()
    return count or 0, not other


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges; the root is the smallest node reached.

    Each round links every node's larger neighbours to its smallest one, then
    its smaller ones; a component is a star after about log(size) rounds.
    Every round is written to the shared folder.  A node's neighbours are
    never gathered: its smallest is an aggregate, joined back, and AQE splits a
    node that many edges share.  ``rows``: about how many edges, if known (``durable``).
    """
    pair = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    now = durable(edges.where("a <> b").select(*pair).distinct(), "edges", rows)
    count, stars = _state(now)
    while not stars:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = durable(small, "edges", count)
        count, stars = _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
